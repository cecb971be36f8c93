"""Models plugged in by the user: document reading and face detection.

A client is made once per task by a function the user gives; Spark decides which rows go where.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import MODEL_ATTEMPTS
from ..session import scratch_path
from .extraction import response_issues

#: ``(content, mime_type, error_feedback) -> response text``
ReadDocument = Callable[[bytes, str, str | None], str]
#: ``content -> [((x1, y1, x2, y2), embedding), ...]``, empty when there is no face
DetectFaces = Callable[[bytes], list[tuple[tuple[float, float, float, float], list[float]]]]


def run_model(
    documents: DataFrame, make_client: Callable[[], ReadDocument], max_attempts: int = MODEL_ATTEMPTS
) -> DataFrame:
    """Ask the model about ``documents(document_id, content, mime_type)``: ``(document_id, attempt, raw)``.

    One round per attempt. A round's answers are written to the shared folder before they are judged,
    so a paid call is not repeated when an executor is lost, and only documents whose answer was not
    usable, with the reason as feedback, go into the next round.
    """
    spark = documents.sparkSession
    id_type = documents.schema["document_id"].dataType.simpleString()
    path = scratch_path(spark, "model-attempts")
    waiting = documents.withColumn("feedback", F.lit(None).cast("string"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            rows = zip(batch["content"], batch["mime_type"], batch["feedback"])
            raw = [client(bytes(c), m, None if pd.isna(f) else f) for c, m, f in rows]
            yield pd.DataFrame({"document_id": batch["document_id"], "raw": raw})

    for attempt in range(1, max_attempts + 1):
        answers = waiting.mapInPandas(ask, f"document_id {id_type}, raw string")
        answers.withColumn("attempt", F.lit(attempt)).write.parquet(f"{path}/round={attempt}")
        judged = response_issues(spark.read.parquet(f"{path}/round={attempt}"))
        unusable = judged.filter(F.col("issue").isNotNull()).select("document_id", F.col("issue").alias("feedback"))
        waiting = documents.join(unusable, "document_id")
    rounds = spark.read.parquet(*[f"{path}/round={n}" for n in range(1, max_attempts + 1)])
    return rounds.select("document_id", "attempt", "raw")


def detect_faces(images: DataFrame, make_client: Callable[[], DetectFaces]) -> DataFrame:
    """Faces of ``images(case_id, doc_type, content)``, numbered per image; an image without faces has no row."""
    id_type = images.schema["case_id"].dataType.simpleString()
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    schema = f"face_id int, case_id {id_type}, doc_type string, box {box}, embedding array<float>"

    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        names = ("x1", "y1", "x2", "y2")
        for batch in batches:
            rows = [
                (n, case, kind, dict(zip(names, corners)), vector)
                for case, kind, content in zip(batch["case_id"], batch["doc_type"], batch["content"])
                for n, (corners, vector) in enumerate(client(bytes(content)))
            ]
            if rows:
                yield pd.DataFrame(rows, columns=["face_id", "case_id", "doc_type", "box", "embedding"])

    uploaded = images.filter(F.col("content").isNotNull())
    return uploaded.select("case_id", "doc_type", "content").mapInPandas(detect, schema)
