"""Graph operators over import edges: neighbours, hops, decay closure, cycles.

Each is a loop of joins over the edge table with a frontier that shrinks; a round's result is written, so neither the
plan nor a lost executor's recomputation grows with the number of rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.session import Scratch, cut

HARD = 1.0
HOP_DECAY = 0.88
MAX_HOPS = 32
LEAST_DECAY = 0.01
#: So many checkpointed rounds are read as they are before they are written as one.
ROUNDS = 6


def merged_edges(edges: DataFrame) -> DataFrame:
    """One edge for each pair, with the highest confidence; loops left out."""
    return edges.where(F.col("importer_file") != F.col("imported_file")).groupBy("importer_file", "imported_file").agg(F.max("confidence").alias("confidence"))


def undirected(edges: DataFrame, least: float = 0.0) -> DataFrame:
    """``a, b, confidence`` in both directions, the best confidence of each pair."""
    own = edges.where((F.col("confidence") >= least) & (F.col("importer_file") != F.col("imported_file")))
    forth = own.select(F.col("importer_file").alias("a"), F.col("imported_file").alias("b"), "confidence")
    return forth.unionByName(forth.select(F.col("b").alias("a"), F.col("a").alias("b"), "confidence")).groupBy("a", "b").agg(F.max("confidence").alias("confidence"))


def neighbors(edges: DataFrame, least: float = 0.0) -> DataFrame:
    """The undirected neighbours of every file, as ``file_path, neighbor, confidence``."""
    return undirected(edges, least).toDF("file_path", "neighbor", "confidence")


def hops(edges: DataFrame, sources: DataFrame, scope: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Least number of undirected hard edges from any of ``sources`` to each file, inside ``scope`` if given."""
    pairs = undirected(edges, HARD).select("a", "b")
    if scope is not None:
        pairs = pairs.join(scope.select(F.col("file_path").alias("b")).distinct(), "b", "left_semi")
    pairs = cut(pairs)
    frontier = cut(sources.select("file_path").distinct().withColumn("hops", F.lit(0)))
    seen, step = frontier, 0
    while most is None or step < most:
        step += 1
        ahead = frontier.join(pairs, F.col("file_path") == F.col("a")).select(F.col("b").alias("file_path")).distinct()
        frontier = cut(ahead.join(seen.select("file_path"), "file_path", "left_anti").withColumn("hops", F.lit(step)))
        if step != most and frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)  # all parts are checkpoints
        seen = cut(seen) if step % ROUNDS == 0 else seen
    return seen


def closure(edges: DataFrame, starts: DataFrame, most: int = MAX_HOPS, decay: float = HOP_DECAY, least: float = LEAST_DECAY) -> DataFrame:
    """``start, file_path, decay, hops``: the best product of confidences and hop decay on any path, soft edges included.

    Paths stop at ``most`` hops, and no path goes on from a product under ``least``.  The start itself is not a row.
    """
    with Scratch(edges.sparkSession) as scratch:
        pairs = scratch.keep(undirected(edges).where(F.col("confidence") > 0))
        best = scratch.keep(starts.select(F.col("file_path").alias("start")).distinct().select("start", F.col("start").alias("file_path"), F.lit(1.0).alias("decay"), F.lit(0).alias("hops")))
        frontier = best
        for step in range(1, most + 1):
            ahead = frontier.where(F.col("decay") >= least).join(pairs, F.col("file_path") == F.col("a"))
            ahead = ahead.select("start", F.col("b").alias("file_path"), (F.col("decay") * F.lit(decay) * F.col("confidence")).alias("decay"))
            ahead = ahead.groupBy("start", "file_path").agg(F.max("decay").alias("decay")).withColumn("hops", F.lit(step))
            known = best.select("start", "file_path", F.col("decay").alias("known"))
            frontier = scratch.keep(ahead.join(known, ["start", "file_path"], "left").where(F.col("known").isNull() | (F.col("decay") > F.col("known"))).drop("known"))
            if frontier.isEmpty():
                break
            best = scratch.keep(best.join(frontier.select("start", "file_path"), ["start", "file_path"], "left_anti").unionByName(frontier))
        return cut(best.where(F.col("start") != F.col("file_path")))


def _trimmed(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges between vertices that have both an edge in and an edge out, again and again."""
    n = -1
    while True:
        inner = edges.select(F.col("a").alias("v")).intersect(edges.select(F.col("b").alias("v")))
        edges = scratch.keep(edges.join(inner.withColumnRenamed("v", "a"), "a", "left_semi").join(inner.withColumnRenamed("v", "b"), "b", "left_semi"))
        count = edges.count()
        if count == n or not count:
            return edges
        n = count


def _reach(edges: DataFrame, values: DataFrame, scratch: Scratch) -> DataFrame:
    """The greatest value that reaches each vertex along edges: ``v, value`` until nothing changes."""
    values = scratch.keep(values)
    changed = values
    while True:
        ahead = changed.join(edges, F.col("v") == F.col("a")).groupBy("b").agg(F.max("value").alias("new")).withColumnRenamed("b", "v")
        changed = scratch.keep(values.join(ahead, "v").where(F.col("new") > F.col("value")).select("v", F.col("new").alias("value")))
        if changed.isEmpty():
            return values
        values = scratch.keep(values.join(changed, "v", "left_anti").unionByName(changed))


def components(edges: DataFrame, least: float = HARD) -> DataFrame:
    """``file_path, component`` of the strongly connected components with two or more files, over directed hard edges.

    By colouring: every vertex takes the greatest vertex that reaches it; what the greatest of a colour reaches back
    inside its colour is one component.  Found components go, and the rest is coloured again.
    """
    own = edges.where((F.col("confidence") >= least) & (F.col("importer_file") != F.col("imported_file")))
    with Scratch(edges.sparkSession) as scratch:
        own = _trimmed(own.select(F.col("importer_file").alias("a"), F.col("imported_file").alias("b")).distinct(), scratch)
        found = None
        while not own.isEmpty():
            vertices = own.select(F.col("a").alias("v")).distinct()
            colour = _reach(own, vertices.withColumn("value", F.col("v")), scratch)
            inside = own.join(colour.select(F.col("v").alias("a"), F.col("value").alias("x")), "a").join(colour.select(F.col("v").alias("b"), F.col("value").alias("y")), "b").where(F.col("x") == F.col("y"))
            back = scratch.keep(inside.select(F.col("b").alias("a"), F.col("a").alias("b")))
            marked = _reach(back, colour.select("v", F.when(F.col("v") == F.col("value"), 1).otherwise(0).alias("value")), scratch).where(F.col("value") == 1)
            part = scratch.keep(marked.select("v").join(colour, "v").select(F.col("v").alias("file_path"), F.col("value").alias("component")))
            found = part if found is None else found.unionByName(part)
            gone = part.select(F.col("file_path").alias("v"))
            own = _trimmed(own.join(gone.withColumnRenamed("v", "a"), "a", "left_anti").join(gone.withColumnRenamed("v", "b"), "b", "left_anti"), scratch)
        if found is None:
            return edges.select(F.col("importer_file").alias("file_path"), F.col("importer_file").alias("component")).limit(0)
        many = found.groupBy("component").agg(F.count("*").alias("n"), F.min("file_path").alias("name")).where(F.col("n") > 1)
        return cut(found.join(many, "component").select("file_path", F.col("name").alias("component")))


def cycles(edges: DataFrame, most: int = 3) -> DataFrame:
    """The ``most`` longest import cycles, as sorted lists of files."""
    own = components(edges).groupBy("component").agg(F.array_sort(F.collect_set("file_path")).alias("files"))
    return own.select("component", "files", F.size("files").alias("n")).orderBy(F.desc("n"), "component").limit(most)
