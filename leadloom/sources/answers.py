"""Answers of a language model about people, read strictly, and people refined by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values
ROLE_GROUPS = ("primary", "secondary", "professional", "other", "unknown")
CONFIDENCES = ("high", "medium", "low")
# End of fixed values

ANSWER = (
    "struct<people:array<struct<name:string,title:string,linkedin_url:string,source_url:string,decision_maker:boolean,role_group:string,"
    "decision_maker_confidence:string,decision_maker_reason:string,evidence:string>>>"
)


def without_fences(answer: Column) -> Column:
    """The JSON of an answer that may stand between Markdown fences."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(answer), r"^```(?:json)?", ""), r"```$", ""))


def parse_answer(answer: Column) -> Column:
    """The answer's people, or null unless it is JSON of the agreed form: each person has a name, a known role group and confidence, and a flag."""
    people = F.from_json(without_fences(answer), ANSWER, {"mode": "PERMISSIVE"})["people"]
    good = lambda p: (F.trim(p["name"]) != "") & p["decision_maker"].isNotNull() & p["role_group"].isin(*ROLE_GROUPS) & p["decision_maker_confidence"].isin(*CONFIDENCES)
    return F.when(F.forall(people, lambda p: F.coalesce(good(p), F.lit(False))), people)


def refine_people(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """People of each company after the model's answer (company_id, homepage_url, context, answer).

    Only companies with candidates (company_id, ordinal, name, title, linkedin_url, source_url) are refined. Without a context, or with an answer of another
    form, the candidates stay, with role unknown and low confidence. A person without a page gets the homepage."""
    read = answers.select("company_id", "homepage_url", F.when(F.coalesce("context", F.lit("")) != "", parse_answer(F.col("answer"))).alias("found"))
    known = candidates.select("company_id").distinct()
    told = read.where("found is not null").join(known, "company_id", "left_semi").select("company_id", "homepage_url", F.posexplode("found").alias("ordinal", "p"))
    told = told.select(
        "company_id", F.col("ordinal").cast("long").alias("ordinal"), "p.name", "p.title", "p.linkedin_url", F.coalesce(F.nullif("p.source_url", F.lit("")), "homepage_url").alias("source_url"),
        F.col("p.decision_maker").alias("is_decision_maker"), "p.role_group", F.col("p.decision_maker_confidence").alias("confidence"), F.col("p.decision_maker_reason").alias("reason"), F.lit(True).alias("refined"),
    )
    kept = candidates.join(read.where("found is not null").select("company_id"), "company_id", "left_anti")
    kept = kept.select("company_id", F.col("ordinal").cast("long").alias("ordinal"), "name", "title", "linkedin_url", "source_url", F.lit(False).alias("is_decision_maker"), F.lit("unknown").alias("role_group"), F.lit("low").alias("confidence"), F.lit(None).cast("string").alias("reason"), F.lit(False).alias("refined"))
    return told.unionByName(kept)


def prompts(contexts: DataFrame, candidates: DataFrame) -> DataFrame:
    """company_id, prompt: a request to a language model for the people of each company that has a context (company_id, context), in our own words. Candidates (company_id, ordinal, name,
    title) found by rules come first, in order; answers are JSON of the form that parse_answer reads."""
    line = F.concat(F.lit("- "), F.col("name"), F.coalesce(F.concat(F.lit(" | "), F.nullif("title", F.lit(""))), F.lit("")))
    lines = candidates.where("name is not null").groupBy("company_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    told = contexts.where("context <> ''").join(lines, "company_id", "left")
    said = F.concat(
        F.lit("Candidates found by rules:\n"), F.coalesce("lines", F.lit("- none")), F.lit("\n\nPages:\n"), F.col("context"),
        F.lit(f"\n\nReturn only people of this company as JSON: people, a list of name, title, linkedin_url, source_url, decision_maker, role_group ({', '.join(ROLE_GROUPS)}), decision_maker_confidence ({', '.join(CONFIDENCES)}), decision_maker_reason and evidence."),
    )
    return told.select("company_id", said.alias("prompt"))
