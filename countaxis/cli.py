"""Command line: prepare, preprocess, fit-reference, signal, infer, run. Exit status 0, 1 for an error, 2 for wrong arguments."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from countaxis import api
from countaxis.operators.clones import DEFAULT, METHODS
from countaxis.sources import bundle as bundles
from countaxis.sources import panel as panels


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="countaxis", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, *groups) -> argparse.ArgumentParser:
        p = verbs.add_parser(name)
        for g in groups:
            g(p)
        return p

    def inputs(p):
        p.add_argument("--matrix", required=True)
        p.add_argument("--cells", required=True)
        p.add_argument("--genes", required=True)

    def more(p):
        p.add_argument("--reference")
        p.add_argument("--alleles")
        p.add_argument("--genetic-map")

    def settings(p):
        p.add_argument("--seed", type=int, default=42)
        p.add_argument("--permutations", type=int, default=199)

    def inference(p):
        p.add_argument("--bootstraps", type=int, default=64)
        p.add_argument("--draws", type=int, default=256)
        p.add_argument("--method", choices=METHODS, default=DEFAULT)

    def out(p):
        p.add_argument("--out", required=True)

    verb("prepare", inputs, more, out)
    p = verb("preprocess", inputs, out)
    for name in ("allele-folder", "phased", "genetic-map"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--reference")
    p = verb("fit-reference", inputs, out)
    p.add_argument("--panel", required=True)
    p.add_argument("--method", choices=("global", "regional_consensus"), default="global")
    p = verb("signal", settings)
    p.add_argument("bundle")
    p = verb("infer", settings, inference, out)
    p.add_argument("bundle")
    verb("run", inputs, more, settings, inference, out)
    return top


def main(argv: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    spark = SparkSession.builder.appName("countaxis").getOrCreate()
    made = lambda *names: api.Settings(**{n: getattr(a, n) for n in names})
    try:
        if a.verb == "prepare":
            api.prepare(spark, a.matrix, a.cells, a.genes, a.reference, a.alleles, a.genetic_map, a.out)
        elif a.verb == "preprocess":
            api.preprocess(spark, a.matrix, a.cells, a.genes, a.allele_folder, a.phased, a.genetic_map, a.reference, a.out)
        elif a.verb == "fit-reference":
            api.fit_reference(spark, a.matrix, a.cells, a.genes, panels.read(spark, a.panel)[0], a.out, method=a.method)
        elif a.verb == "signal":
            row = api.signal(bundles.read(spark, a.bundle), made("seed", "permutations"))[0].head()
            print(json.dumps(row.asDict()))
        else:
            chosen = made("seed", "permutations", "bootstraps", "draws", "method")
            if a.verb == "infer":
                api.infer(bundles.read(spark, a.bundle), chosen).save(a.out)
            else:
                api.run(spark, a.matrix, a.cells, a.genes, a.reference, a.alleles, a.genetic_map, chosen, a.out)
    except (ValueError, RuntimeError, OSError, AnalysisException) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
