"""Directed graphs as edge tables (source, target). Rounds are cut by checkpoints in the shared folder, so a lost executor costs a read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JUMP_FROM, TRIMS = 4, 3  # rounds: both steer the work only, not the result


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. One under /tmp serves where it is unset, on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return (found or "file:///tmp/checkpoints").rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def _plain(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").filter("source is not null and target is not null").distinct()


def _spread(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, mark) of nodes (id, mark), each with the least mark that reaches it; the second field of a mark is the id it began at.

    Least marks travel along edges until none changes, one join and one combined aggregation a round. After JUMP_FROM rounds each node
    also takes the mark of the node that its own mark began at, which reaches it too, so that long chains halve.
    """
    known, r = cut(nodes), 0
    while True:
        near = edges.join(known.toDF("source", "via"), "source").groupBy(F.col("target").alias("id")).agg(F.min("via").alias("via"))
        after = cut(known.join(near, "id", "left").select("id", F.least("mark", "via").alias("mark"), F.col("mark").alias("was")))
        if after.filter("mark <> was").isEmpty():
            return known
        known, r = after.select("id", "mark"), r + 1
        if r >= JUMP_FROM:
            there = known.select(F.col("id").alias("begin"), F.col("mark").alias("further"))
            known = cut(known.join(there, F.col("mark.id") == F.col("begin"), "left").select("id", F.least("mark", "further").alias("mark")))


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("id"))


def origins(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, origin): for each node that ``starts`` (id) reaches, the least start that does. Starts mark before all other nodes."""
    edges = cut(_plain(edges))
    ranked = _ends(edges).select("id", F.lit(1).alias("rank")).unionByName(starts.select("id", F.lit(0).alias("rank"))).groupBy("id").agg(F.min("rank").alias("rank"))
    marked = _spread(edges, ranked.select("id", F.struct("rank", "id").alias("mark")))
    return marked.filter("mark.rank = 0").select("id", F.col("mark.id").alias("origin"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every strongly connected component of more than one node, named by its least member.

    Nodes that lie on no cycle are trimmed first, for a few rounds: a node stays while it has both an edge in and an edge out among those that stay.
    Then, in rounds, every node learns the least id that reaches it (forward) and the least id that it reaches (backward) within
    its current part; nodes whose two agree form that id's component, and the rest is divided by the pair and taken up again.
    """
    left = cut(_plain(edges).filter("source <> target"))
    out: DataFrame | None = None
    while True:
        left = _trimmed(left)
        if left.isEmpty():
            break
        forward, backward = _least(left), _least(left.toDF("target", "source").select("source", "target"))
        both = cut(forward.toDF("id", "f").join(backward.toDF("id", "b"), "id"))
        found = both.filter("f = b").select("id", F.col("f").alias("component"))
        out = found if out is None else out.unionByName(found)
        # edges inside a found component, or between nodes of different marks, are on no other cycle
        mark = F.struct("f", "b")
        x = both.select(F.col("id").alias("source"), mark.alias("ms"), (F.col("f") == F.col("b")).alias("done"))
        y = both.select(F.col("id").alias("target"), mark.alias("mt"))
        left = cut(left.join(x, "source").join(y, "target").filter("not done and ms = mt").select("source", "target"))
    if out is None:
        return edges.sparkSession.createDataFrame([], edges.select(F.col("source").alias("id"), F.col("source").alias("component")).schema)
    return out.join(out.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component"), "component", "left_semi").select("id", "component")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges without some of those on no cycle. A layer goes a round, so what is left of a long chain goes by marks: after TRIMS rounds
    another follows only where the last took a tenth of the edges."""
    n, r = edges.count(), 0
    while n:
        edges = cut(edges.join(edges.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(edges.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"))
        m, r = edges.count(), r + 1
        if m == n or (r >= TRIMS and 10 * m > 9 * n):
            break
        n = m
    return edges


def _least(edges: DataFrame) -> DataFrame:
    """(id, least) for every node of the edges: the least id that reaches it, itself included."""
    nodes = _ends(edges).distinct().select("id", F.struct(F.lit(0).alias("rank"), "id").alias("mark"))
    return _spread(edges, nodes).select("id", F.col("mark.id").alias("least"))


def shortest_path(edges: DataFrame, starts: DataFrame, goals: DataFrame, most: int) -> list:
    """Ids on a shortest path of at most ``most`` edges from some start to some goal, ties by least ids; empty without one. The
    frontier is a table; only the path itself, of at most ``most`` + 1 ids, reaches the driver."""
    edges, goals = cut(_plain(edges)), cut(goals.select("id").distinct())
    seen = cut(starts.select("id", F.array("id").alias("path")).distinct())
    front = seen
    for depth in range(most + 1):
        if hit := front.join(goals, "id", "left_semi").orderBy("path").select("path").first():
            return list(hit["path"])
        if depth == most:
            break
        step = front.select(F.col("id").alias("source"), "path").join(edges, "source").groupBy(F.col("target").alias("id")).agg(F.min("path").alias("before"))
        front = cut(step.join(seen.select("id"), "id", "left_anti").select("id", F.concat("before", F.array("id")).alias("path")))
        seen = cut(seen.unionByName(front))
    return []
