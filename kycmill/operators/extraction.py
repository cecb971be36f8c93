"""Document evidence: MRZ lines, MRZ validation, model responses, one extraction per document."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.mrz import LINE_LENGTH, cut, filled_name, last_digits, short_date, weighted_digit
from ..schemas import MODEL_ATTEMPTS, MODEL_RESPONSE, MRZ_MODEL, NO_FACE_IN_IMAGE, RETRIES_EXHAUSTED

MIN_LINE = 30


def attach_blobs(documents: DataFrame, blobs: DataFrame) -> DataFrame:
    """Add the digest of each document's object; a missing object means "not uploaded yet", no error.

    The digest is taken where the object is read: 64 characters go into the join, not the image.
    """
    digests = blobs.select("s3_key", F.sha2("content", 256).alias("sha256"))
    found = documents.join(digests, "s3_key", "left")
    return found.withColumn("is_uploaded", F.col("sha256").isNotNull())


def load_content(documents: DataFrame, blobs: DataFrame) -> DataFrame:
    """Add the object itself, for the documents that go to a model; others should be dropped before."""
    return documents.join(blobs.select("s3_key", "content"), "s3_key", "left")


def photo_pair_digest(pairs: DataFrame, blobs: DataFrame) -> DataFrame:
    """Digest of ID photo and selfie together, null while one of them is missing.

    Keys go to the images, not images to the keys: each image that is asked for meets the (narrow) list of
    wanted keys, and the two of a pair come together in one aggregate.
    """
    keys = ["id_document_key", "selfie_key"]
    asked = pairs.select(*keys).distinct()
    sides = [F.struct(F.col(k).alias("s3_key"), F.lit(i).alias("side")) for i, k in enumerate(keys)]
    wanted = asked.select(*keys, F.explode(F.array(*sides)).alias("w")).select(*keys, "w.*").filter("s3_key IS NOT NULL")
    found = blobs.select("s3_key", "content").join(wanted, "s3_key")

    def image(side: int) -> Column:
        return F.max(F.when(F.col("side") == side, F.col("content")))

    digests = found.groupBy(*keys).agg(F.sha2(F.concat(image(0), image(1)), 256).alias("input_hash"))
    return pairs.join(digests, keys, "left")


def mrz_lines(boxes: DataFrame) -> DataFrame:
    """The two lowest long text boxes of each document as padded MRZ lines; nulls when fewer than two."""
    text = F.upper(F.regexp_replace("text", r"\s", ""))
    top = F.array_min(F.transform("bbox", lambda point: F.get(point, F.lit(1))))
    long_enough = F.length("line") >= MIN_LINE
    lines = boxes.select("document_id", text.alias("line"), top.alias("top"))
    lowest = Window.partitionBy("document_id").orderBy(F.desc("top"), F.desc("line"))
    two = (
        lines.filter(long_enough)
        .withColumn("place", F.row_number().over(lowest))
        .filter(F.col("place") <= 2)
    )
    padded = F.rpad("line", LINE_LENGTH, "<")
    found = two.groupBy("document_id").agg(
        F.max(F.when(F.col("place") == 2, padded)).alias("line1"),
        F.max(F.when(F.col("place") == 1, padded)).alias("line2"),
    )
    whole = found.filter(F.col("line1").isNotNull())
    return boxes.select("document_id").distinct().join(whole, "document_id", "left")


def _parse_zone(zone: Column, as_of: dt.date) -> Column:
    """Fields and failed checks of one pair of lines."""
    l1, l2, whole, clean = zone["line1"], zone["line2"], zone["whole"], zone["clean"]
    birth = short_date(cut(l2, 13, 19), True, as_of.year)
    expiry = short_date(cut(l2, 21, 27), False, as_of.year)

    def digits(*ranges):
        parts = [F.slice(zone["digits"], start + 1, end - start) for start, end in ranges]
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    def wrong(at, *ranges):
        # The check character itself is a digit or the filler; a letter never matches.
        expected = weighted_digit(digits(*ranges), sum(end - start for start, end in ranges))
        return expected != F.translate(cut(l2, at, at + 1), "<", "0")

    checks = [
        ("document_number", wrong(9, (0, 9))),
        ("date_of_birth", wrong(19, (13, 19))),
        ("expiry_date", wrong(27, (21, 27))),
        ("personal_number", (cut(l2, 42, 43) != "<") & wrong(42, (28, 42))),
        ("composite", wrong(43, (0, 10), (13, 20), (21, 43))),
        ("date_of_birth_format", birth.isNull()),
        ("expiry_date_format", expiry.isNull()),
    ]
    failed = (
        F.when(~whole, F.array(F.lit("line_length")))
        .when(~clean, F.array(F.lit("invalid_character")))
        .otherwise(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks])))
    )

    def field(value):
        return F.when(whole & clean, value)

    return F.struct(
        field(filled_name(cut(l1, 5, 44))).alias("full_name"),
        field(F.rtrim(cut(l2, 0, 9), F.lit("<"))).alias("document_number"),
        field(F.rtrim(cut(l2, 10, 13), F.lit("<"))).alias("nationality"),
        field(birth).alias("date_of_birth"),
        field(expiry).alias("expiry_date"),
        field(F.rtrim(cut(l1, 0, 2), F.lit("<"))).alias("document_type"),
        failed.alias("failed_checks"),
    )


def mrz_validate(lines: DataFrame, as_of: dt.date) -> DataFrame:
    """Check digits, dates and fields of line pairs; ``failed_checks`` is empty for a valid zone.

    ``as_of`` decides the century of birth dates, so that results do not change with the day. The lines
    are bound once and parsed as one value: filters on the result do not copy them into every check.
    """
    trimmed = [F.upper(F.regexp_replace(c, r"^\s+|\s+$", "")).alias(c) for c in ("line1", "line2")]
    l1, l2 = F.col("line1"), F.col("line2")
    whole = F.coalesce((F.length(l1) == LINE_LENGTH) & (F.length(l2) == LINE_LENGTH), F.lit(False))
    # Every position a check reads; nationality and sex may hold anything.
    checked_text = F.concat(cut(l2, 0, 10), cut(l2, 13, 20), cut(l2, 21, 44))
    zone = F.struct(
        "line1",
        "line2",
        last_digits(l2).alias("digits"),
        whole.alias("whole"),
        F.coalesce(checked_text.rlike(r"^[0-9A-Z<]*\z"), F.lit(False)).alias("clean"),
    )
    parsed = F.get(F.transform(F.array(zone), lambda z: _parse_zone(z, as_of)), F.lit(0))
    texts = ["full_name", "document_number", "nationality", "document_type"]
    filled = [F.when(F.col(f"zone.{c}") != "", F.col(f"zone.{c}")).alias(c) for c in texts]
    return (
        lines.select("document_id", *trimmed)
        .select("document_id", parsed.alias("zone"))
        .select("document_id", *filled, "zone.date_of_birth", "zone.expiry_date", "zone.failed_checks")
        .withColumn("valid", F.size("failed_checks") == 0)
    )


# Spellings of a truth value a model response may use.
TRUE_TEXT = ("true", "t", "yes", "y", "on", "1")
FALSE_TEXT = ("false", "f", "no", "n", "off", "0")


def response_issues(attempts: DataFrame) -> DataFrame:
    """Parse each attempt; ``issue`` is null for a usable response, else the first thing wrong with it.

    An answer is one JSON object and nothing after it: put in brackets it must be an array of one. Members of
    the document must be texts (or null where they may be left out); a number or an object is not taken for one.
    """
    alone = F.from_json(F.concat(F.lit("["), "raw", F.lit("]")), "array<struct<document_visible string>>")
    parsed = attempts.withColumn(
        "response",
        F.from_json("raw", MODEL_RESPONSE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}),
    )
    whole = F.coalesce(F.size(alone) == 1, F.lit(False))
    doc = F.col("response.document")
    visible = F.lower("response.document_visible")

    def blank(name):
        return F.coalesce(doc[name], F.lit("")) == ""

    def other_type(name):
        member = F.try_variant_get(F.try_parse_json("raw"), f"$.document.{name}", "variant")
        return ~F.coalesce(F.schema_of_variant(member), F.lit("VOID")).isin("STRING", "VOID")

    def good_date(name):
        shaped = doc[name].rlike(r"^\d{4}-\d{2}-\d{2}\z") & doc[name].try_cast("date").isNotNull()
        return F.coalesce(shaped, F.lit(False))

    has_doc = doc.isNotNull()
    issue = (
        F.when(F.col("response").isNull() | F.col("response._corrupt").isNotNull() | ~whole, F.lit("not valid JSON"))
        .when(~F.coalesce(visible.isin(*TRUE_TEXT, *FALSE_TEXT), F.lit(False)), F.lit("document_visible missing"))
        .when(has_doc & blank("full_name"), F.lit("full_name empty"))
        .when(has_doc & blank("document_number"), F.lit("document_number empty"))
        .when(has_doc & blank("document_type"), F.lit("document_type empty"))
        .when(has_doc & ~good_date("date_of_birth"), F.lit("date_of_birth invalid"))
        .when(
            has_doc & doc["expiry_date"].isNotNull() & ~good_date("expiry_date"), F.lit("expiry_date invalid")
        )
        .when(visible.isin(*FALSE_TEXT) | ~has_doc, F.lit("no document visible"))
    )
    for name in ("nationality", "expiry_date", "date_of_birth", "document_type", "document_number", "full_name"):
        issue = F.when(has_doc & other_type(name), F.lit(f"{name} not a text")).otherwise(issue)
    issue = F.when(F.col("response").isNotNull() & ~whole, F.lit("not valid JSON")).otherwise(issue)
    return parsed.withColumn("issue", issue)


def response_resolve(attempts: DataFrame, max_attempts: int = MODEL_ATTEMPTS) -> DataFrame:
    """First usable response per document; later ones are trusted less, none means human review.

    A document that has neither a usable response nor used up its attempts is still being worked on and left out.
    """
    tried = response_issues(attempts).filter(F.col("attempt") <= max_attempts)
    good = F.when(F.col("issue").isNull(), F.col("attempt"))
    per_document = tried.groupBy("document_id").agg(
        F.min(good).alias("good_attempt"),
        F.min_by("response.document", good).alias("document"),
        F.max_by("issue", "attempt").alias("last_issue"),
        F.max("attempt").alias("tried"),
    )
    found = F.col("good_attempt").isNotNull()
    per_document = per_document.filter(found | (F.col("tried") >= max_attempts))
    trust = F.greatest(F.lit(0.5), F.lit(1.0) - F.lit(0.15) * (F.col("good_attempt") - 1))
    reason = F.concat(F.lit(RETRIES_EXHAUSTED.format(attempts=max_attempts)), F.col("last_issue"))
    return per_document.select(
        "document_id",
        F.when(found, F.col("document")).alias("document"),
        F.when(found, trust).otherwise(F.lit(0.0)).alias("confidence"),
        F.lit("vlm").alias("method"),
        (~found).alias("needs_review"),
        F.when(~found, reason).alias("reason"),
    )


def mrz_accepted(mrz: DataFrame) -> DataFrame:
    """Every zone as an extraction, with ``accepted`` telling whether it may stand for the document.

    A zone is accepted when it is valid and fills every mandatory document field. Rows are flagged, not
    filtered: a filter would be pushed below the parsing and make it run once more per condition.
    """
    good = F.col("valid") & F.col("full_name").isNotNull() & F.col("document_number").isNotNull()
    document = F.struct(
        "full_name",
        "document_number",
        F.col("date_of_birth").cast("string").alias("date_of_birth"),
        F.col("expiry_date").cast("string").alias("expiry_date"),
        "nationality",
        F.coalesce("document_type", F.lit("unknown")).alias("document_type"),
    )
    return mrz.select(
        "document_id",
        good.alias("accepted"),
        document.alias("document"),
        F.lit(0.99).alias("confidence"),
        F.lit("mrz").alias("method"),
        F.lit(False).alias("needs_review"),
        F.lit(None).cast("string").alias("reason"),
    )


def needs_model(documents: DataFrame, mrz: DataFrame) -> DataFrame:
    """Documents without an accepted zone: only these go to the expensive model."""
    flags = mrz_accepted(mrz).select("document_id", "accepted")
    flagged = documents.join(flags, "document_id", "left")
    return flagged.filter(~F.coalesce("accepted", F.lit(False))).drop("accepted")


def extraction_resolve(mrz: DataFrame, responses: DataFrame, model: str = "model") -> DataFrame:
    """One extraction per document: the zone when it is accepted, else the resolved model response.

    A document with neither has not been answered yet and is left out.
    """
    zones = mrz_accepted(mrz).select("document_id", "accepted", F.struct("*").alias("m"))
    answered = responses.select("document_id", F.struct("*").alias("r"))
    fields = ["document", "confidence", "method", "needs_review", "reason"]
    joined = zones.join(answered, "document_id", "full_outer")
    by_zone = F.coalesce("accepted", F.lit(False))
    best = [F.when(by_zone, F.col(f"m.{f}")).otherwise(F.col(f"r.{f}")).alias(f) for f in fields]
    version = F.when(F.col("method") == "mrz", F.lit(MRZ_MODEL)).otherwise(F.lit(model))
    return (
        joined.filter(by_zone | F.col("r").isNotNull())
        .select("document_id", *best)
        .withColumn("model_version", version)
    )


def face_match(pairs: DataFrame, faces: DataFrame) -> DataFrame:
    """Similarity of the largest face of each case's two images; null, with a reason, without a face."""
    from ..functions.columns import dot

    box = F.col("box")
    area = (box["x2"] - box["x1"]) * (box["y2"] - box["y1"])
    size = F.struct(area.alias("area"), (-F.col("face_id")).alias("first"))

    def largest(doc_type: str):
        return F.max_by("embedding", F.when(F.col("doc_type") == doc_type, size)).alias(doc_type)

    # Both images of a case in one aggregate: no self join, and each task keeps one vector per image.
    per_case = faces.groupBy("case_id").agg(largest("id_document"), largest("selfie"))
    both = F.col("id_document").isNotNull() & F.col("selfie").isNotNull()
    score = F.when(both, dot(F.col("id_document"), F.col("selfie")))
    return pairs.join(per_case, "case_id", "left").select(
        "case_id",
        score.alias("similarity_score"),
        score.isNull().alias("needs_review"),
        F.when(score.isNull(), F.lit(NO_FACE_IN_IMAGE)).alias("reason"),
    )
