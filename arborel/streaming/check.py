"""Incremental rule checks of a stream of documents; beyond what batch jobs need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from arborel.operators import rules
from arborel.operators.nodes import line_nodes


def check_stream(docs: DataFrame, of: list[rules.Rule], out: str, checkpoint: str) -> StreamingQuery:
    """Checks each batch of (doc_id, lang, text) once and adds its violations under out, one folder a batch, so that a
    batch that runs again replaces its own rows."""

    def run(batch: DataFrame, number: int) -> None:
        rows = batch.select("doc_id", "lang", "text")
        rules.violations(rows, line_nodes(rows, "text", "doc_id", "lang"), of, "doc_id", "lang").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
