"""Growing a graph from a stream of triplet files.

Each micro-batch appends its provenance to a table under a folder of its own batch id, so a
batch that is run again after a failure replaces what it wrote and counts once.  The graph is a view over
that table; merging new names happens when the graph is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessergraph import schema
from tessergraph.operators.graph import Graph
from tessergraph.operators.triplets import Triplets


def grow(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream in the TRIPLET layout (triplet_ord may be left out) to the provenance table at ``path``."""

    def add(batch: DataFrame, batch_id: int) -> None:
        Triplets(batch).sources().dropDuplicates(["triplet_id"]).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def grown(spark: SparkSession, path: str, domain: str | None = None) -> Graph:
    """The graph of everything appended so far; a triplet that came in two batches counts once."""
    s = spark.read.schema(schema.SOURCE).option("recursiveFileLookup", True).parquet(path)
    own = s.groupBy("triplet_id").agg(F.min(F.struct("src", "relation", "dst", "ord")).alias("k"), F.first("metadata").alias("metadata"))
    t = own.select(F.col("k.ord").alias("triplet_ord"), F.col("k.src").alias("node_1"), F.col("k.relation").alias("edge"), F.col("k.dst").alias("node_2"), "metadata")
    return Graph.build(Triplets(t), domain=domain)


def event_triplets(events: DataFrame) -> DataFrame:
    """(node_1, edge, node_2, metadata) of events: a user did something to a kind of thing."""
    meta = F.create_map(F.lit("chunk_id"), F.col("event_id").cast("string"))
    return events.select(F.col("event_id").alias("triplet_ord"), F.concat(F.lit("U"), "user_id").alias("node_1"), F.col("event_type").alias("edge"), F.concat(F.lit("K"), F.get_json_object("props", "$.k")).alias("node_2"), meta.alias("metadata"))


def relation_counts(stream: DataFrame, watermark: str = "10 minutes", window: str = "1 hour", ts: str = "ts") -> DataFrame:
    """(start, relation, n) per window; rows later than the watermark are dropped once their window is final."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", watermark)
    return timed.groupBy(F.window("_ts", window), F.col("event_type").alias("relation")).agg(F.count("*").alias("n")).select("window.start", "relation", "n")


def run_to_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """relation_counts over the events as a stream that ends with the files there are, from a table in the shared folder."""
    from tessergraph.runtime import shared_dir
    import uuid

    kind = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(kind).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    counted = stream.groupBy(F.col("event_type").alias("relation")).agg(F.count("*").alias("n"))
    path = f"{shared_dir(spark)}/tg-{name}-{uuid.uuid4().hex}"
    q = counted.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/out")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out")
