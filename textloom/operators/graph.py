"""Document and feature graph: nodes (id, type, props), edges (src, dst, relation, weight).

Defined results: duplicate edges add up; a document in several of the asked corpora counts once; an edge to a node that
doesn't exist is followed no further.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType
from pyspark.sql.window import Window as W

from textloom.session import checkpoint

FEATURES = ("EXHIBITS_DEVICE", "CO_OCCURS_WITH", "HAS_AFFECT")
#: Nodes that a dense spectrum is computed for on the driver, and that one sort numbers.
SPECTRUM_NODES, NUMBERED_AT_ONCE = 2_000, 1_000_000


def weights(edges: DataFrame) -> DataFrame:
    """doc, feature, w: duplicate edges added up, before any join."""
    return edges.filter(F.col("relation").isin(*FEATURES)).groupBy(F.col("src").alias("doc"), F.col("dst").alias("feature")).agg(F.sum("weight").alias("w"))


def cooccurrence(w: DataFrame) -> DataFrame:
    """i, j, value = sum over documents of w_i w_j, the diagonal included.

    A document joins with itself, feature by feature: as many pairs as the square of its distinct features, never of its edges.
    """
    a, b = w.select("doc", F.col("feature").alias("i"), F.col("w").alias("wi")), w.select("doc", F.col("feature").alias("j"), F.col("w").alias("wj"))
    return a.join(b, "doc").groupBy("i", "j").agg(F.sum(F.col("wi") * F.col("wj")).alias("value"))


def corpus_matrix(edges: DataFrame, corpora: list[str]) -> DataFrame:
    docs = edges.filter((F.col("relation") == "BELONGS_TO") & F.col("dst").isin(*corpora)).select(F.col("src").alias("doc")).distinct()
    return cooccurrence(weights(edges).join(docs, "doc", "left_semi"))


def laplacian(m: DataFrame) -> DataFrame:
    """i, j, value of D - A for the symmetrised matrix; the diagonal of A cancels."""
    a = m.unionByName(m.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")).groupBy("i", "j").agg((F.sum("value") / 2).alias("value"))
    off = a.filter("i != j").withColumn("value", -F.col("value"))
    diagonal = a.filter("i = j").select("i").unionByName(off.select("i")).distinct().join(off.groupBy("i").agg((-F.sum("value")).alias("value")), "i", "left")
    return off.unionByName(diagonal.select("i", F.col("i").alias("j"), F.coalesce("value", F.lit(0.0)).alias("value")))


def spectrum(lap: DataFrame, k: int = 10) -> DataFrame:
    """rank, eigenvalue: the k smallest.

    Up to SPECTRUM_NODES nodes the matrix is solved whole on the driver. Beyond, a Lanczos iteration works on it where it lies: the
    driver holds vectors of one number a node, and each step is one pass over the matrix.
    """
    nodes = lap.filter("i = j").select("i").distinct()
    n = nodes.count()
    if n <= SPECTRUM_NODES:
        rows = lap.collect()
        at = {name: k_ for k_, name in enumerate(sorted({r["i"] for r in rows}))}
        dense = np.zeros((len(at), len(at)))
        for r in rows:
            dense[at[r["i"]], at[r["j"]]] = r["value"]
        values = np.linalg.eigvalsh(dense)[:k] if at else []
    else:
        values = _lanczos(lap, nodes, n, k)
    return lap.sparkSession.createDataFrame([(r, round(float(v), 6)) for r, v in enumerate(values)], "rank int, eigenvalue double")


def _lanczos(lap: DataFrame, nodes: DataFrame, n: int, k: int, steps: int | None = None) -> np.ndarray:
    """The k smallest eigenvalues of a Laplacian of n nodes, by Lanczos with full reorthogonalisation on (bound - L)."""
    number = checkpoint(nodes.withColumn("k", F.row_number().over(W.orderBy("i")) - 1)) if n <= NUMBERED_AT_ONCE else checkpoint(nodes.rdd.zipWithIndex().map(lambda r: (r[0]["i"], r[1])).toDF("i string, k long"))
    m = lap.join(number.withColumnRenamed("k", "a"), "i").join(number.select(F.col("i").alias("j"), F.col("k").alias("b")), "j")
    m = checkpoint(m.select("a", "b", "value"))
    bound = 2.0 * (m.filter("a = b").agg(F.max("value")).first()[0] or 0.0)  # no eigenvalue is above twice the largest degree
    sc = lap.sparkSession.sparkContext

    def times(v: np.ndarray) -> np.ndarray:
        shared = sc.broadcast(v)

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    x = b["value"].to_numpy() * shared.value[b["b"].to_numpy()]
                    a, at = np.unique(b["a"].to_numpy(), return_inverse=True)
                    yield pd.DataFrame({"a": a, "x": np.bincount(at, x, len(a))})

        out = np.zeros(n)
        for r in m.mapInPandas(part, "a long, x double").groupBy("a").agg(F.sum("x").alias("x")).toLocalIterator():
            out[r["a"]] = r["x"]
        shared.unpersist()
        return bound * v - out

    steps = min(n, steps or 4 * k + 20)
    q = np.random.default_rng(0).standard_normal(n)
    basis, alpha, beta = [q / np.linalg.norm(q)], [], []
    for _ in range(steps):
        w = times(basis[-1])
        alpha.append(float(w @ basis[-1]))
        for b in basis:
            w = w - (w @ b) * b
        for b in basis:  # once more, for what rounding left
            w = w - (w @ b) * b
        size = float(np.linalg.norm(w))
        if size < 1e-9 * max(1.0, bound):
            break
        beta.append(size)
        basis.append(w / size)
    t = np.diag(alpha) + np.diag(beta[: len(alpha) - 1], 1) + np.diag(beta[: len(alpha) - 1], -1)
    return np.sort(bound - np.linalg.eigvalsh(t))[:k]


def jaccard(m: DataFrame) -> DataFrame:
    """i, j, value = 2 m_ij / (m_ii + m_jj), 0 where that has no meaning."""
    d = m.filter("i = j").select(F.col("i").alias("n"), F.col("value").alias("d"))
    out = m.join(d.select(F.col("n").alias("i"), F.col("d").alias("di")), "i", "left").join(d.select(F.col("n").alias("j"), F.col("d").alias("dj")), "j", "left").na.fill(0.0, ["di", "dj"])
    total = F.col("di") + F.col("dj")
    return out.select("i", "j", F.when(total > 0, 2 * F.col("value") / total).otherwise(0.0).alias("value"))


def divergence(target: DataFrame, corpus: DataFrame) -> DataFrame:
    """i, j, value: difference of the Jaccard matrices over all nodes of both."""
    a = jaccard(target).withColumnRenamed("value", "t")
    return a.join(jaccard(corpus).withColumnRenamed("value", "c"), ["i", "j"], "full").select("i", "j", (F.coalesce("t", F.lit(0.0)) - F.coalesce("c", F.lit(0.0))).alias("value"))


def reach(nodes: DataFrame, edges: DataFrame, start: list[str], depth: int = 2) -> DataFrame:
    """src, dst, relation, weight of all edges that leave nodes within `depth` steps of `start`."""
    spark = nodes.sparkSession
    seen = frontier = spark.createDataFrame([(s,) for s in start], "id string").join(nodes.select("id"), "id", "left_semi")
    out = None
    for _ in range(depth):
        step = edges.join(frontier.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst", "relation", "weight")
        out = step if out is None else out.unionAll(step)
        frontier = step.select(F.col("dst").alias("id")).distinct().join(nodes.select("id"), "id", "left_semi").join(seen, "id", "left_anti")
        seen = seen.unionAll(frontier)
    return out


def upsert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace those of the same id; of several new ones the largest row counts, so that the result doesn't hang on their order."""
    rest = [c for c in new.columns if c != "id"]
    plain = [F.to_json(F.col(c)) if isinstance(new.schema[c].dataType, MapType) else F.col(c) for c in rest]
    best = new.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct(*plain)).alias("s")).select("id", "s.*")
    return nodes.join(new.select("id"), "id", "left_anti").unionByName(best)


def remove_document(nodes: DataFrame, edges: DataFrame, doc: str) -> tuple[DataFrame, DataFrame]:
    return nodes.filter(F.col("id") != doc), edges.filter((F.col("src") != doc) & (F.col("dst") != doc))


def reindex(edges: DataFrame, new: DataFrame) -> DataFrame:
    """A document's edges are replaced by the new ones, so that indexing twice changes nothing."""
    return edges.join(new.select("src").distinct(), "src", "left_anti").unionByName(new)


def index(docs: DataFrame, features: DataFrame, least: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of documents (doc, corpus) and their features (doc, node, kind, relation, weight).

    Features that weigh less than `least` are left out, except devices, which count 1.
    """
    kept = features.filter((F.col("kind") == "StylisticDevice") | (F.abs("weight") >= least))
    edges = kept.select(F.col("doc").alias("src"), F.col("node").alias("dst"), "relation", "weight")
    member = docs.filter("corpus IS NOT NULL").select(F.col("doc").alias("src"), F.col("corpus").alias("dst"), F.lit("BELONGS_TO").alias("relation"), F.lit(1.0).alias("weight"))
    nodes = docs.select(F.col("doc").alias("id"), F.lit("Document").alias("type")).unionAll(docs.filter("corpus IS NOT NULL").select("corpus", F.lit("Corpus"))).unionAll(kept.select("node", "kind"))
    return nodes.distinct(), edges.unionAll(member)


def degrees(edges: DataFrame) -> DataFrame:
    """src, relation, features: how many nodes each node reaches by each relation."""
    return edges.groupBy("src", "relation").agg(F.countDistinct("dst").alias("features"))


def corpora(edges: DataFrame) -> DataFrame:
    """corpus, documents: every corpus with the number of its documents."""
    return edges.filter("relation = 'BELONGS_TO'").groupBy(F.col("dst").alias("corpus")).agg(F.countDistinct("src").alias("documents"))


def corpus_documents(nodes: DataFrame, edges: DataFrame, corpus: str) -> DataFrame:
    """id and all else that is known of the documents of a corpus."""
    members = edges.filter((F.col("relation") == "BELONGS_TO") & (F.col("dst") == corpus)).select(F.col("src").alias("id")).distinct()
    return nodes.join(members, "id", "left_semi")


def document_matrix(edges: DataFrame, doc: str) -> DataFrame:
    """i, j, value of one document alone."""
    return cooccurrence(weights(edges.filter(F.col("src") == doc)))


def window_matrices(features: DataFrame, key: list[str]) -> DataFrame:
    """i, j, value over the windows of one analysis: features (key..., node, weight), of a window or of a text."""
    w = features.groupBy(F.concat_ws(" ", *[F.col(k).cast("string") for k in key]).alias("doc"), F.col("node").alias("feature")).agg(F.sum("weight").alias("w"))
    return cooccurrence(w)


def frobenius(d: DataFrame) -> DataFrame:
    """norm: the Frobenius norm of a matrix (i, j, value)."""
    return d.agg(F.round(F.coalesce(F.sqrt(F.sum(F.col("value") * F.col("value"))), F.lit(0.0)) + 1e-9, 6).alias("norm"))


def fiedler(spectrum_: DataFrame) -> DataFrame:
    """fiedler: the second smallest eigenvalue, how well the graph hangs together."""
    return spectrum_.filter("rank = 1").select(F.col("eigenvalue").alias("fiedler"))


def related(nodes: DataFrame, edges: DataFrame, start: str, depth: int = 2) -> DataFrame:
    """relation, features: how many nodes, without the start, the edges within `depth` steps of a node lead to."""
    return reach(nodes, edges, [start], depth).filter(F.col("dst") != start).groupBy("relation").agg(F.countDistinct("dst").alias("features"))


def set_property(nodes: DataFrame, node: str, name: str, value: str) -> DataFrame:
    """A property (in `props`, a map) of one node set anew."""
    rest = F.map_filter(F.coalesce("props", F.expr("map()").cast("map<string,string>")), lambda k, _: k != name)
    return nodes.withColumn("props", F.when(F.col("id") == node, F.map_concat(rest, F.create_map(F.lit(name), F.lit(value)))).otherwise(F.col("props")))


def remove_corpus(nodes: DataFrame, edges: DataFrame, corpus: str) -> tuple[DataFrame, DataFrame]:
    """The graph without a corpus; its documents stay."""
    return nodes.filter(F.col("id") != corpus), edges.filter(~((F.col("relation") == "BELONGS_TO") & (F.col("dst") == corpus)))
