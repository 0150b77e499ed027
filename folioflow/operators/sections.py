"""Academic sections: headings by rules, sections as the lines between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text_expr as T

# Headings by section type.
ALIASES = {
    "abstract": ("abstract", "summary"),
    "introduction": ("introduction", "background"),
    "literature_review": ("literature review", "review of literature", "related work", "previous studies"),
    "methodology": ("methodology", "methods", "method", "materials and methods", "research methodology"),
    "results": ("results", "findings"),
    "discussion": ("discussion", "analysis"),
    "conclusion": ("conclusion", "conclusions", "concluding remarks"),
    "references": ("references", "bibliography", "works cited"),
}
# Chapter numbers of theses.
CHAPTERS = {"4": "results", "5": "discussion", "6": "conclusion"}
# What a heading line looks like, what opens the references and results, and the longest title.
NUMBERED_HEADING = r"^\s*(?:\p{Nd}+(?:\.\p{Nd}+)*[.)]?\s+)?([A-Za-z][A-Za-z &/-]{2,80})\s*:?\s*$"
#: The same without steps back, which can't help: what they give up is spaces, which follow the title anyway.
NUMBERED_LINE = NUMBERED_HEADING.replace("{2,80})", "{2,80}+)")
REFERENCES = ("references", "bibliography", "works cited")
RESULTS = "^(?:results of |findings from |findings of )"
MAX_TITLE_LENGTH = 180
#: The same openings in a lower-case line whose other characters aren't taken out yet.
REFERENCES_RAW = "^(?:" + "|".join("[^a-z0-9 &/-]*".join(" +" if c == " " else c for c in r) for r in REFERENCES) + ")"


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(T.strip(c)), "[^a-z0-9 &/-]+", ""), r"\s+", " ")


def heading_parts(line: Column) -> Column:
    """Of a stripped line: itself, whether it opens the references, and its plain heading, null if it has none. The
    heading is made here once, for lines of the right form only."""
    opens = F.lower(line).rlike(rf"(?s)^[^a-z0-9 &/-]*+{REFERENCES_RAW[1:]}")
    return F.struct(
        line.alias("line"), opens.alias("opens"),
        F.when(~opens & line.rlike(NUMBERED_LINE), _plain(F.regexp_extract(line, NUMBERED_LINE, 1))).alias("heading"),
    )


def kind_of(parts: Column) -> Column:
    """The section type that a line with these parts opens, or null."""
    aliases = F.create_map(*[F.lit(x) for kind, names in ALIASES.items() for name in names for x in (name, kind)])
    other = F.when(parts["heading"].rlike(RESULTS), "results")
    for number, name in CHAPTERS.items():
        other = other.when(parts["line"].rlike(rf"^\s*{number}(?:\.\p{{Nd}}+)+"), name)
    return F.when(parts["opens"], "references").when(
        parts["heading"].isNotNull(), F.coalesce(F.try_element_at(aliases, parts["heading"]), other)
    )


def classify_heading(line: Column) -> Column:
    """The section type that a line opens, or null."""
    return F.get(F.transform(F.transform(F.array(line), heading_parts), kind_of), F.lit(0))


def is_probable_title(line: Column) -> Column:
    l = T.strip(line)
    return (
        (l != "") & (F.length(l) <= MAX_TITLE_LENGTH) & classify_heading(l).isNull()
        & ~l.rlike(r"[.:;]\z") & l.rlike(r"\p{L}")
    )


def section_name(kind: Column) -> Column:
    return F.initcap(F.replace(kind, F.lit("_"), F.lit(" ")))


def detect_sections(df: DataFrame, text_col: str = "cleaned_text", out_col: str = "sections") -> DataFrame:
    """Add an array of sections: a title line, then what follows each heading up to the next.

    Lines before the first heading belong to no section. Without headings a text is its title, or, without a title,
    one unknown section. Everything happens within the row.
    """
    text = T.text_or_empty(F.col(text_col))
    df = df.withColumn("_text", text).withColumn("_lines", T.lines(F.col("_text")))
    df = df.withColumn("_bare", F.transform("_lines", T.strip))
    df = df.withColumn("_types", F.transform(F.transform("_bare", heading_parts), kind_of))
    n, lines, types = F.size("_lines"), F.col("_lines"), F.col("_types")
    numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_heads", F.filter(numbers, lambda i: F.get(types, i).isNotNull()))
    df = df.withColumn("_first", F.get(F.filter(numbers, lambda i: F.get("_bare", i) != ""), F.lit(0)))
    # character offsets: a running sum that is kept at headings only, and what blank lines take before the first line
    sum_at = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("heads"))
    marked = F.zip_with("_lines", "_types", lambda l, t: F.struct(F.length(l).alias("n"), t.isNotNull().alias("head")))
    df = df.withColumn("_at", F.aggregate(marked, sum_at, lambda acc, x: F.struct(
        (acc["at"] + x["n"] + 1).alias("at"), F.when(x["head"], F.array_append(acc["heads"], acc["at"])).otherwise(acc["heads"]).alias("heads")
    )))
    df = df.withColumn("_blank", F.aggregate(F.slice("_lines", 1, F.coalesce("_first", F.lit(0))), F.lit(0), lambda t, l: t + F.length(l) + 1))
    heads, at, first = F.col("_heads"), F.col("_at"), F.col("_first")

    def section(kind, heading, body, first, last, begin, end, sure) -> Column:
        return F.struct(
            kind.alias("section_type"), section_name(kind).alias("section_name"), heading.alias("heading"),
            heading.alias("detected_heading"), body.alias("text"), begin.cast("int").alias("start_index"),
            end.cast("int").alias("end_index"), F.lit(sure).alias("confidence"), first.alias("start_line"), last.alias("end_line"),
        )

    def under(s: Column) -> Column:
        h, last = s["h"], s["last"]
        body = T.strip(F.array_join(F.transform(F.slice(lines, h + 2, last - h), lambda l: F.rtrim(l, F.lit(T.SPACES))), "\n"))
        return section(s["type"], s["heading"], body, h, last, s["begin"], s["end"] - 1, 0.95)

    spans = F.transform(heads, lambda h, k: F.struct(
        h.alias("h"), (F.coalesce(F.get(heads, k + 1), n) - 1).alias("last"), F.get(types, h).alias("type"), T.strip(F.get(lines, h)).alias("heading"),
        F.get(at["heads"], k).alias("begin"), F.coalesce(F.get(at["heads"], k + 1), at["at"]).alias("end"),
    ))
    df = df.withColumn("_spans", spans).withColumn("_title", T.strip(F.get(lines, first)))
    df = df.withColumn("_titled", F.coalesce(is_probable_title(F.col("_title")), F.lit(False)))
    title = section(F.lit("title"), F.lit("Title"), F.col("_title"), first, first, F.col("_blank"), F.col("_blank") + F.length(F.get(lines, first)), 0.75)
    unknown = section(
        F.lit("unknown"), F.lit("Unknown"), T.strip(F.col("_text")), F.lit(0), F.greatest(n - 1, F.lit(0)),
        F.lit(0), F.length("_text"), 0.0,
    )
    blank = section(F.lit("unknown"), F.lit("Unknown"), F.lit(""), F.lit(0), F.lit(0), F.lit(0), F.lit(0), 0.0)
    df = df.withColumn("_body", F.transform("_spans", under))
    sections = (
        F.when(first.isNull(), F.array(blank))
        .when(F.col("_titled"), F.concat(F.array(title), F.col("_body")))
        .when(F.size("_body") > 0, F.col("_body"))
        .otherwise(F.array(unknown))
    )
    return df.withColumn(out_col, sections).drop(
        "_text", "_lines", "_bare", "_types", "_heads", "_first", "_at", "_blank", "_spans", "_title", "_titled", "_body"
    )


def explode_sections(df: DataFrame, *keys: str, sections_col: str = "sections") -> DataFrame:
    """One row per section, with its position."""
    return T.exploded(df, sections_col, "section_pos", "_section", *keys).select(*keys, "section_pos", "_section.*")
