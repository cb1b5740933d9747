"""Command line: python -m driftmap.plans.cli --input points.csv --output out --dimension 784 --knnMethod project"""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from ..sources import coo
from .pipeline import Settings, embed, embed_knn, explain


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="A neighbour-preserving map of vectors or of a distance table")
    for name in ("--input", "--output"):
        p.add_argument(name, required=True)
    p.add_argument("--dimension", type=int, required=True)
    p.add_argument("--knnMethod", choices=["bruteforce", "partition", "project"], required=True)
    p.add_argument("--inputDistanceMatrix", action="store_true")
    p.add_argument("--executionPlan", action="store_true")
    p.add_argument("--metric", default="sqeuclidean")
    p.add_argument("--perplexity", type=float, default=30.0)
    p.add_argument("--nComponents", type=int, default=2)
    p.add_argument("--earlyExaggeration", type=float, default=4.0)
    p.add_argument("--learningRate", type=float, default=1000.0)
    p.add_argument("--iterations", type=int, default=300)
    p.add_argument("--randomState", type=int, default=0)
    p.add_argument("--neighbors", type=int)
    p.add_argument("--initialMomentum", type=float, default=0.5)
    p.add_argument("--finalMomentum", type=float, default=0.8)
    p.add_argument("--theta", type=float, default=0.25)
    p.add_argument("--loss", "--lossFile", default="loss.txt")
    p.add_argument("--knnIterations", type=int, default=3)
    p.add_argument("--knnBlocks", type=int)
    p.add_argument("--planFile", default="execution_plan.txt")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("driftmap").getOrCreate()
    s = Settings(a.metric, a.perplexity, a.earlyExaggeration, a.learningRate, a.iterations, a.randomState, a.neighbors, a.initialMomentum, a.finalMomentum, a.theta, a.knnMethod, a.knnIterations, a.knnBlocks, a.nComponents)
    data = coo.read_distances(spark, a.input) if a.inputDistanceMatrix else coo.coo_to_vectors(coo.read_coo(spark, a.input), a.dimension)
    if a.executionPlan:
        Path(a.planFile).write_text(explain(data, s, a.dimension))
        return
    result = embed_knn(data, s) if a.inputDistanceMatrix else embed(data, s)
    coo.write_embedding(result.embedding, a.output)
    Path(a.loss).write_text(coo.loss_text(result.loss) + "\n")


if __name__ == "__main__":
    main()
