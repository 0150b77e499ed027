"""Research information by keyword rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text_expr as T
from folioflow.operators.summaries import split_sentences

# Per field the sections in which it is expected, and its keywords.
RULES = {
    "research_problem": (("abstract", "introduction", "unknown"), ("problem", "challenge", "gap", "lack", "limited", "difficulty", "need", "issue")),
    "objectives": (("abstract", "introduction", "methodology"), ("objective", "objectives", "aim", "aims", "purpose", "goal", "seeks", "intends")),
    "research_questions": (("abstract", "introduction", "methodology"), ("research question", "rq", "question", "questions", "hypothesis", "hypotheses")),
    "methodology": (("methodology", "methods"), ("method", "methodology", "approach", "survey", "interview", "experiment", "regression", "qualitative", "quantitative", "mixed-method")),
    "dataset_sample": (("methodology", "methods", "results"), ("dataset", "data set", "sample", "participants", "respondents", "observations", "records", "cases")),
    "variables": (("methodology", "methods", "results"), ("variable", "variables", "dependent variable", "independent variable", "predictor", "outcome", "measure", "measures")),
    "findings": (("results", "discussion", "conclusion"), ("finding", "findings", "found", "results show", "results indicate", "showed", "revealed", "improved", "increase", "decrease")),
    "limitations": (("discussion", "conclusion", "limitations"), ("limitation", "limitations", "limited by", "constraint", "constraints", "threat", "bias")),
    "future_work": (("discussion", "conclusion", "future_work"), ("future work", "future research", "future studies", "further research", "should explore", "recommend", "recommendation")),
}
# Warnings.
NO_TEXT = "No text was available for research information extraction."
NO_PATTERN = "No research information patterns were detected with local rules."
KEYWORDS = sorted({k for _, ks in RULES.values() for k in ks})
#: Keywords as whole words at a place, seen from before it, so that they may overlap: none of one kind begins another of
#: that kind, and a phrase may begin with a word.
SINGLE, PHRASE = (
    rf"(?<!{T.WORD_CHAR})(?=({'|'.join(k for k in KEYWORDS if (' ' in k) == phrase)})(?!{T.WORD_CHAR}))" for phrase in (False, True)
)


# Fixed value: list marks and numbers before a unit.
UNIT_MARK = r"\A\s*(?:[-*]|\p{Nd}+[.)]|[A-Z]{1,4}\p{Nd}*[:.)])\s*"


def clean_unit(c: Column) -> Column:
    """Without list marks in front, with single spaces, without colons and dashes at the ends."""
    bare = F.regexp_replace(c, UNIT_MARK, "")
    return F.regexp_replace(F.regexp_replace(bare, rf"{T.SPACE}+", " "), r"\A[ :-]+|[ :-]+\z", "")


def candidate_units(c: Column) -> Column:
    """Sentences of lines, and short lines with a colon, a question or a number like RQ1 as a whole."""
    lines = F.transform(T.lines(c), lambda l: F.struct(T.strip(l).alias("line"), clean_unit(l).alias("clean")))
    lines = F.filter(lines, lambda x: x["clean"].rlike(T.ANALYSIS_WORD))
    parts = F.transform(lines, lambda x: F.struct(x["line"].alias("line"), x["clean"].alias("clean"), split_sentences(x["clean"]).alias("sentences")))

    def units(x: Column) -> Column:
        whole = (F.length(x["clean"]) <= 180) & (x["clean"].contains(":") | x["clean"].endswith("?") | x["line"].rlike(r"(?i)^(?:RQ|H)\p{Nd}+"))
        return F.when((F.size(x["sentences"]) <= 1) & whole, F.array(x["clean"])).otherwise(x["sentences"])

    return F.transform(F.filter(F.flatten(F.transform(parts, units)), lambda u: u.rlike(T.ANALYSIS_WORD)), clean_unit)


def found_keywords(unit: Column) -> Column:
    """All keywords of all fields in a unit: two searches, whatever the number of keywords."""
    low = F.lower(unit)
    return F.concat(*[F.regexp_extract_all(low, F.lit(p), F.lit(1)) for p in (SINGLE, PHRASE)])


def _matched(unit: Column, found: Column, field: str) -> Column:
    matched = F.array_intersect(F.array(*map(F.lit, RULES[field][1])), found)
    if "question" in RULES[field][1]:
        matched = F.when(unit.contains("?") & ~F.array_contains(matched, "question"), F.array_append(matched, F.lit("question"))).otherwise(matched)
    return matched


def extract_research_information(sections: DataFrame, *keys: str, max_items_per_field: int = 3) -> DataFrame:
    """(keys, field, rank, extracted_text, source_section, confidence, matched_keywords) of the best items per field.

    The nine rules are expressions on a unit, so units fan out only to the fields that accept them. Of equal items
    (letters and digits only) the first stays; items rank by confidence, section, text.
    """
    if max_items_per_field < 1:
        raise ValueError("item limit must be positive")
    kind = F.coalesce(F.nullif(F.lower(T.strip(F.col("section_type"))), F.lit("")), F.lit("unknown"))
    name = F.coalesce(F.nullif(T.strip(F.col("section_name")), F.lit("")), F.lit("Unknown"))
    # searched and chosen within the row: a filter on an exploded unit's keywords would search for them a second time
    searched = F.transform(candidate_units(F.col("text")), lambda u, i: F.struct(i.alias("pos"), u.alias("unit"), found_keywords(u).alias("found")))
    rows = sections.select(*keys, "section_pos", kind.alias("kind"), name.alias("source_section"), searched.alias("_units"))
    chosen = F.filter("_units", lambda x: (F.size(x["found"]) > 0) | x["unit"].contains("?") | F.col("kind").isin(*RULES["methodology"][0]))
    units = T.exploded(rows, chosen, "_pos", "_x", *keys, "section_pos", "kind", "source_section")
    units = units.select(*keys, "section_pos", "kind", "source_section", F.col("_x.pos").alias("unit_pos"), F.col("_x.unit").alias("unit"), F.col("_x.found").alias("_found"))
    fields = F.array(*[
        F.struct(F.lit(f).alias("field"), F.col("kind").isin(*RULES[f][0]).alias("preferred"), _matched(F.col("unit"), F.col("_found"), f).alias("matched_keywords")) for f in RULES
    ])
    rows = units.select("*", F.explode_outer(fields).alias("_f")).select(*keys, "section_pos", "unit_pos", "unit", "source_section", "_f.*")
    rows = rows.where((F.size("matched_keywords") > 0) | ((F.col("field") == "methodology") & F.col("preferred")))
    marks = F.when(F.col("unit").contains(":") | F.col("unit").contains("?"), 5).otherwise(0)
    points = 35 + F.when(F.col("preferred"), 25).otherwise(0) + F.least(10 * F.size("matched_keywords"), F.lit(30)) + marks
    rows = rows.withColumn("confidence", F.least(points, F.lit(95)) / 100)
    rows = rows.withColumn("_same", F.trim(F.regexp_replace(F.lower("unit"), "[^a-z0-9]+", " ")))
    first = Window.partitionBy(*keys, "field", "_same").orderBy("section_pos", "unit_pos")
    best = Window.partitionBy(*keys, "field").orderBy(F.desc("confidence"), "source_section", "unit")
    return (
        rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max_items_per_field)
        .select(*keys, "field", "rank", F.col("unit").alias("extracted_text"), "source_section", "confidence", "matched_keywords")
    )


def primary_fields(documents: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """A row per document and field: the first item, or nulls with confidence 0."""
    every = documents.select(key, F.explode(F.array(*map(F.lit, RULES))).alias("field"))
    first = items.where("rank = 1").select(key, "field", "extracted_text", "source_section", "confidence")
    return every.join(first, [key, "field"], "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def research_warnings(documents: DataFrame, sections: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """(key, warnings): no text in any section, or nothing found in the text."""
    some = sections.where(T.strip(F.col("text")) != "").select(key).distinct().withColumn("_some", F.lit(True))
    hits = items.select(key).distinct().withColumn("_hit", F.lit(True))
    found = F.array(F.when(F.col("_some").isNull(), NO_TEXT), F.when(F.col("_some") & F.col("_hit").isNull(), NO_PATTERN))
    out = documents.select(key).join(some, key, "left").join(hits, key, "left")
    return out.select(key, F.filter(found, lambda w: w.isNotNull()).alias("warnings"))
