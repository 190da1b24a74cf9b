"""Questions with known answers about a fleet, their evaluation, and the deterministic parts around language models."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: greatest scores of the five classes of evaluation questions
SCORES = {"factual": 1, "comparison": 2, "reasoning": 3, "operational": 2, "anomaly": 2}


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th."""
    teen = (n % 100).between(11, 13)
    return F.concat(n.cast("string"), F.when(teen, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th"))


def singular(word: Column) -> Column:
    """The word without its plural: policies, classes, hosts; address keeps its s."""
    return F.when(word.rlike("ies$"), F.regexp_replace(word, "ies$", "y")).when(word.rlike("(ss|x|ch|sh)es$"), F.regexp_replace(word, "es$", "")).when(word.rlike("[^s]s$"), F.regexp_replace(word, "s$", "")).otherwise(word)


def single_value(leaves: DataFrame) -> DataFrame:
    """(entity_id, path, question, answer): a question a leaf."""
    return leaves.select("entity_id", "path", F.concat(F.lit("What is "), "path", F.lit(" of "), "entity_id", F.lit("?")).alias("question"), F.col("value").alias("answer"))


def multi_entity(leaves: DataFrame) -> DataFrame:
    """(path, value, n, answer): values that two entities or more share but not all, with the entities in order."""
    total = leaves.agg(F.count_distinct("entity_id").alias("total"))
    each = leaves.groupBy("path", "value").agg(F.count_distinct("entity_id").alias("n"), F.array_join(F.array_sort(F.collect_set("entity_id")), ", ").alias("answer"))
    return each.where("n >= 2").crossJoin(F.broadcast(total)).where("n < total").drop("total")  # total is one row


def existence(leaves: DataFrame) -> DataFrame:
    """(entity_id, path, answer): whether an entity has a path, for paths that some have and some lack."""
    n = leaves.agg(F.count_distinct("entity_id").alias("total"))
    partial = leaves.groupBy("path").agg(F.count_distinct("entity_id").alias("n")).crossJoin(F.broadcast(n)).where("n < total").select("path")  # n is one row
    # paths are as many as the schema is long; by an exchange on them all entities of a path would meet in one task
    has = leaves.join(F.broadcast(partial), "path").select("entity_id", "path", F.lit("yes").alias("answer")).distinct()
    # entities of equal path sets lack the same paths, so only distinct sets are looked at
    sets = leaves.groupBy("entity_id").agg(F.array_sort(F.collect_set("path")).alias("paths")).groupBy("paths").agg(F.min("entity_id").alias("entity_id"))
    every = partial.agg(F.collect_set("path").alias("every"))  # one row, as long as the schema
    lacks = sets.crossJoin(F.broadcast(every)).select("entity_id", F.explode(F.array_except("every", "paths")).alias("path"))
    return has.unionByName(lacks.groupBy("path").agg(F.min("entity_id").alias("entity_id")).select("entity_id", "path", F.lit("no").alias("answer")))


def comparison(leaves: DataFrame, least_presence: float = 0.5) -> DataFrame:
    """(path, all_same): of paths that ``least_presence`` of the entities have."""
    total = leaves.agg(F.count_distinct("entity_id").alias("total"))
    per = leaves.groupBy("path").agg(F.count_distinct("value").alias("d"), F.count_distinct("entity_id").alias("n"))
    return per.crossJoin(F.broadcast(total)).where(f"n >= {least_presence} * total").select("path", F.expr("d = 1").alias("all_same"))  # total is one row


def count(leaves: DataFrame) -> DataFrame:
    """(entity_id, prefix, n): distinct second words of paths under each first word."""
    p = F.split("path", r"\.")
    return leaves.where(F.size(p) >= 2).groupBy("entity_id", p[0].alias("prefix")).agg(F.count_distinct(p[1]).alias("n"))


def ordering(items: DataFrame, keys: list[str], at: str, item: str) -> DataFrame:
    """(keys, first, last, k, ordinal, item, next): the place of each item and what follows it."""
    w = Window.partitionBy(*keys).orderBy(at, item)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    k = F.row_number().over(w)
    return items.select(*keys, F.first(item).over(whole).alias("first"), F.last(item).over(whole).alias("last"), k.alias("k"), ordinal(k).alias("ordinal"), F.col(item).alias("item"), F.lead(item).over(w).alias("next"))


def stratified(questions: DataFrame, category: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n questions, one of each category at least, then by the seed's order."""
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    k = F.row_number().over(Window.partitionBy(category).orderBy(drawn, key))
    return questions.withColumn("_drawn", drawn).withColumn("_first", k > 1).orderBy("_first", "_drawn", key).limit(n).drop("_drawn", "_first")


def bank(leaves: DataFrame) -> DataFrame:
    """(id, category, question, answer, evidence) of all categories as one table; ids are hashes of category and question."""
    say = lambda *parts: F.concat(*(F.col(p[1:]) if p.startswith("$") else F.lit(p) for p in parts))
    parts = (
        single_value(leaves).select(F.lit("SINGLE_VALUE").alias("category"), "question", "answer", "path"),
        multi_entity(leaves).select(F.lit("MULTI_ENTITY").alias("category"), say("Which entities have ", "$path", " = ", "$value", "?").alias("question"), "answer", "path"),
        existence(leaves).select(F.lit("EXISTENCE").alias("category"), say("Does ", "$entity_id", " have ", "$path", "?").alias("question"), "answer", "path"),
        comparison(leaves).select(F.lit("COMPARISON").alias("category"), say("Is ", "$path", " the same everywhere?").alias("question"), F.when(F.col("all_same"), "yes").otherwise("no").alias("answer"), "path"),
        count(leaves).select(F.lit("COUNT").alias("category"), say("How many members has ", "$prefix", " on ", "$entity_id", "?").alias("question"), F.col("n").cast("string").alias("answer"), F.col("prefix").alias("path")),
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.sha2(F.concat_ws("|", "category", "question"), 256).alias("id"), "category", "question", "answer", F.array("path").alias("evidence"))


def save_bank(questions: DataFrame, path: str) -> None:
    questions.write.mode("overwrite").json(path)


def load_bank(spark, path: str) -> DataFrame:
    return spark.read.schema("id string, category string, question string, answer string, evidence array<string>").json(path)


_WORDS = ((("yes", "true"), "yes"), (("no", "false"), "no"))


def normal_answer(c: Column) -> Column:
    """Lower case, white space folded, marks at the end gone, true as yes and false as no."""
    out = F.rtrim(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), F.lit(".!"))
    for words, to in _WORDS:
        out = F.when(out.isin(*words), to).otherwise(out)
    return out


def correct(answer: Column, truth: Column) -> Column:
    """Whether an answer is right: equal once normalised, equal as numbers, or containing the truth as whole words."""
    a, t = normal_answer(answer), normal_answer(truth)
    number = a.try_cast("double") == t.try_cast("double")
    inside = F.when(t != "", F.contains(F.concat(F.lit(" "), F.regexp_replace(a, r"[,;:()]", " "), F.lit(" ")), F.concat(F.lit(" "), F.regexp_replace(t, r"[,;:()]", " "), F.lit(" "))))
    return F.coalesce((a == t) | F.coalesce(number, F.lit(False)) | F.coalesce(inside, F.lit(False)), F.lit(False))


def accuracy(answers: DataFrame) -> DataFrame:
    """(category, n, accuracy) of (category, answer, truth), and a row with a null category for all."""
    right = answers.withColumn("right", correct(F.col("answer"), F.col("truth")).cast("int"))
    return right.rollup("category").agg(F.count("*").alias("n"), F.round(F.avg("right"), 6).alias("accuracy"))


def weighted(scores: DataFrame) -> DataFrame:
    """(class, n, score, most, share) of (class, score): scores are held between 0 and the most of their class; unknown classes are left out."""
    most = F.create_map(*(F.lit(x) for kv in SCORES.items() for x in kv))[F.col("class")]
    known = scores.withColumn("most", most).where("most is not null").withColumn("score", F.least(F.greatest(F.coalesce("score", F.lit(0)), F.lit(0)), F.col("most")))
    out = known.rollup("class").agg(F.count("*").alias("n"), F.sum("score").alias("score"), F.sum("most").alias("most"))
    return out.withColumn("share", F.round(F.col("score") / F.col("most"), 6))


def fenced(text: str) -> str:
    """What stands in the first fence of an answer, or the answer."""
    m = re.search(r"```[a-zA-Z]*[ \t]*\n(.*?)```", text, re.S)
    return (m[1] if m else text).strip()


def routed_files(answer: str, known: set[str]) -> list[str]:
    """The files that a router's answer names, in order, of those that are known: a JSON list, an object with a list
    under files, or such in a fence or amid text."""
    found = None
    for part in (answer.strip(), fenced(answer), *re.findall(r"\{.*\}|\[.*?\]", answer, re.S)):
        try:
            found = json.loads(part)
            break
        except ValueError:
            continue
    if isinstance(found, dict):
        found = found.get("files", [])
    return list(dict.fromkeys(x for x in found if isinstance(x, str) and x in known)) if isinstance(found, list) else []


def common_prefixes(paths: DataFrame, least: int = 2) -> DataFrame:
    """(prefix, n): first words of paths that ``least`` paths share: what a projection's author chooses subjects from."""
    return paths.select("path").distinct().groupBy(F.split("path", r"\.")[0].alias("prefix")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
