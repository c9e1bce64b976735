"""Notes gated as they arrive: a file stream, each micro-batch through the level 1 gate, exactly once by checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from factledger.operators.claims import claim_rates, level2
from factledger.operators.gate import level1, note_rates
from factledger.operators.mentions import mentions, note_lines

NOTE_DDL = "note_id string, table_id string, note string"


def gate_stream(spark: SparkSession, source: str, tables: DataFrame, target: str, checkpoint: str, claims: str | None = None, rates: str | None = None) -> StreamingQuery:
    """Reads JSON notes from ``source`` and writes labelled numbers to ``target``; where asked for, also labelled claims (read
    by rules) to ``claims`` and the rates of each note to ``rates``. A batch that runs again replaces its own folders, so
    its rows are there once."""

    def write(batch: DataFrame, number: int) -> None:
        put = lambda df, where: df.write.mode("overwrite").parquet(f"{where}/batch={number}")
        lines = note_lines(batch)
        put(level1(mentions(lines), lines, tables), target)
        if claims:
            put(level2(batch, tables), claims)
        if rates:
            numbers = spark.read.parquet(f"{target}/batch={number}")
            out = note_rates(numbers)
            if claims:
                out = out.join(claim_rates(spark.read.parquet(f"{claims}/batch={number}")).drop("table_id"), "note_id", "left")
            put(out, rates)

    return spark.readStream.schema(NOTE_DDL).json(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
