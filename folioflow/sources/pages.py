"""Pages and manifests of uploaded documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text_expr as T

MAX_BYTES = 25 * 1024 * 1024
# Accepted content types.
CONTENT_TYPES = ("application/pdf", "application/x-pdf")


def assemble_pages(pages: DataFrame, key: str = "document_id", page_col: str = "page_no", text_col: str = "text") -> DataFrame:
    """(key, page_count, full_text, has_text): trimmed pages in order, without blank ones, joined by a blank line.
    All pages count. A document's pages meet in one row, as its text is one value."""
    page = F.struct(F.col(page_col).alias("n"), T.strip(T.text_or_empty(F.col(text_col))).alias("t"))
    rows = pages.groupBy(key).agg(F.array_sort(F.collect_list(page)).alias("_p"))
    text = F.array_join(F.transform(F.filter("_p", lambda p: p["t"] != ""), lambda p: p["t"]), "\n\n")
    return rows.select(key, F.size("_p").alias("page_count"), text.alias("full_text")).withColumn("has_text", F.col("full_text") != "")


def clean_metadata(metadata: Column) -> Column:
    """Trimmed values; null and blank ones go."""
    trimmed = F.transform_values(metadata, lambda k, v: T.strip(v))
    return F.map_filter(trimmed, lambda k, v: v.isNotNull() & (v != ""))


def manifest_problem(max_bytes: int = MAX_BYTES) -> Column:
    """Why a manifest row is rejected, or null."""
    kind = F.lower(T.strip(F.split(F.col("mime_type"), ";")[0]))
    return (
        F.when(~F.lower(T.text_or_empty(F.col("original_filename"))).endswith(".pdf"), "not a PDF file name")
        .when(F.col("mime_type").isNotNull() & ~kind.isin(*CONTENT_TYPES), "not a PDF content type")
        .when(F.col("file_size_bytes") > max_bytes, "file is too large")
    )


def validate_manifest(manifest: DataFrame, projects: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Add `problem` (null for accepted rows): name, type, size, and a project that exists."""
    known = projects.select(F.col("id").alias("project_id"), F.lit(True).alias("_known")).distinct()
    out = manifest.join(known, "project_id", "left")
    problem = F.coalesce(manifest_problem(max_bytes), F.when(F.col("_known").isNull(), "project does not exist"))
    return out.withColumn("problem", problem).drop("_known")


def row_problems(documents: DataFrame) -> DataFrame:
    """Add `problems`, an array of broken row constraints; good rows have none."""
    def outside(c: str, low: int, high: int) -> Column:
        return ~F.coalesce(F.length(c).between(low, high), F.lit(False))

    checks = [
        F.when(outside("original_filename", 1, 255), "original_filename"),
        F.when(F.length("mime_type") > 120, "mime_type"),
        *[F.when(F.col(c) < 0, c) for c in ("file_size_bytes", "page_count", "word_count")],
        F.when(outside("status", 1, 50), "status"),
    ]
    return documents.withColumn("problems", F.filter(F.array(*checks), lambda p: p.isNotNull()))


def project_problems(projects: DataFrame) -> DataFrame:
    """Trim names; names of 1 to 200 characters are good."""
    name = T.strip(T.text_or_empty(F.col("name")))
    return projects.withColumn("name", name).withColumn("problems", F.when(~F.length(name).between(1, 200), F.array(F.lit("name"))).otherwise(F.array().cast("array<string>")))


def _safe(c: Column) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+\z", "")
    return F.regexp_replace(cleaned, "_+", "_")


def safe_filename(name: Column) -> Column:
    """A file name of safe characters with a short lower-case extension; null where none can be made."""
    base = F.element_at(F.filter(F.split(F.replace(T.strip(name), F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != ".")), -1)
    # a suffix begins at the last dot that has a name before it and something behind it
    suffix = F.regexp_extract(base, r"^.*[^.].*?(\.[^.]+)$", 1)
    suffix = F.when(F.regexp_replace(base, r"\.[^.]+$", "") != "", suffix).otherwise(F.lit(""))
    suffix = F.when(base.endswith("."), F.lit("")).otherwise(suffix)
    extension = F.substring(F.lower(_safe(F.regexp_replace(suffix, r"^\.", ""))), 1, 20)
    stem = F.substr(base, F.lit(1), F.length(base) - F.length(suffix))
    stem = F.substring(F.coalesce(F.nullif(_safe(stem), F.lit("")), F.lit("document")), 1, 120)
    out = F.when(extension != "", F.concat(stem, F.lit("."), extension)).otherwise(stem)
    return F.when((T.strip(name) == "") | base.isNull() | (base == ".."), F.lit(None)).otherwise(out)


def stored_filename(name: Column, token: Column) -> Column:
    """Token and safe name; a token from a hash of the path makes reruns agree."""
    return F.concat_ws("_", F.coalesce(F.nullif(_safe(token), F.lit("")), F.lit("document")), safe_filename(name))
