"""Command line: ``python -m fleetweave COMMAND``; thin calls of the library, results on standard output."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fleetweave.operators import fleet, hierarchy, questions, sections, tiers
from fleetweave.sources import documents


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="fleetweave")
    sub = top.add_subparsers(dest="command", required=True)
    add = lambda name, what, *args: [p := sub.add_parser(name, help=what), [p.add_argument(*a, **k) for a, k in args]][0]
    source = (("source",), {"help": "folder of documents"})
    add("compress", "factor the documents of a folder into a store", source, (("store",), {}), (("--threshold",), {"type": int, "default": sections.THRESHOLD}), (("--max-delta-pct",), {"type": float, "default": sections.MAX_DELTA_PCT}))
    add("stats", "sizes by section", source)
    add("validate", "reconstruct the documents of a folder and count differences", source)
    add("fleet-info", "hosts and classes of a store", (("store",), {}))
    add("retrieve", "context for a question within a token budget", (("store",), {}), (("question",), {}), (("--budget",), {"type": int, "default": 8000}))
    add("project", "the view of a subject", source, (("--include",), {"action": "append", "required": True}), (("--related",), {"action": "append", "default": []}), (("--engine",), {"default": "archetypal"}))
    add("generate-questions", "a bank of questions with answers", source, (("bank",), {}), (("--most",), {"type": int, "default": 1000}), (("--seed",), {"type": int, "default": 0}))
    add("evaluate", "score answers (JSON lines of category, answer, truth)", (("answers",), {}))
    add("run-eval", "score graded answers (JSON lines of class, score)", (("scores",), {}))
    add("infer-projections", "prefixes of paths that a projection may take as subjects", source)
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> str:
    """The output of a command. What is printed is a report; tables go to the store."""
    lines = lambda df: "\n".join(df.toJSON().collect())  # noqa: E731  (reports of a few rows a type, section or category)
    parsed = lambda: documents.parse(documents.load(spark, args.source))
    if args.command == "compress":
        fleet.save_tables(sections.factor(documents.section_leaves(parsed()), args.threshold, args.max_delta_pct), args.store)
        return lines(fleet.summary(fleet.load_tables(spark, args.store)))
    if args.command == "stats":
        leaves = documents.section_leaves(parsed())
        return fleet.report(leaves, sections.factor(leaves))
    if args.command == "validate":
        leaves = documents.section_leaves(parsed()).where("path <> ''")
        return json.dumps({"differences": sections.differences(leaves, sections.rebuild(sections.factor(leaves))).count()})
    if args.command == "fleet-info":
        f = fleet.load_tables(spark, args.store)
        return lines(fleet.summary(f)) + "\n" + lines(fleet.class_distribution(f))
    if args.command == "retrieve":
        return fleet.retrieve_for(fleet.load_tables(spark, args.store), args.question, args.budget).text
    if args.command == "project":
        attrs = documents.attributes(parsed())
        types, profiles = hierarchy.bootstrap(attrs)
        typed = attrs.join(types, "entity_id")
        h = hierarchy.ENGINES.get(args.engine)(typed, profiles, hierarchy.Config())
        return lines(tiers.tier_b_json(tiers.project(h, tiers.tier_c(typed, profiles, h), tiers.Subject("subject", tuple(args.include), tuple(args.related)))[0]))
    if args.command == "generate-questions":
        bank = questions.stratified(questions.bank(documents.attribute_leaves(documents.attributes(parsed()))), "category", "id", args.most, args.seed)
        questions.save_bank(bank, args.bank)
        return lines(questions.load_bank(spark, args.bank).groupBy("category").agg(F.count("*").alias("n")))
    if args.command == "evaluate":
        return lines(questions.accuracy(spark.read.schema("category string, answer string, truth string").json(args.answers)))
    if args.command == "run-eval":
        return lines(questions.weighted(spark.read.schema("class string, score double").json(args.scores)))
    return lines(questions.common_prefixes(documents.attributes(parsed())))


def main() -> None:
    args = parser().parse_args()
    print(run(SparkSession.builder.appName("fleetweave").getOrCreate(), args))


if __name__ == "__main__":
    main()
