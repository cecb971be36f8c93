"""Column-only building blocks: decimals, digests, keyed signatures, JSON text and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separator between the fields of an audit row hash (ASCII record separator).
FIELD_SEPARATOR = chr(30)

#: Namespace of deterministic entry ids: the URL namespace of RFC 4122, as hex.
URL_NAMESPACE_HEX = "6ba7b8119dad11d180b400c04fd430c8"


def numeric_5_4(value: Column) -> Column:
    """NUMERIC(5,4) as stored by the evidence tables; out-of-range values raise, as there."""
    return value.cast("decimal(5,4)")


def dot(a: Column, b: Column) -> Column:
    """Dot product of two float arrays, accumulated in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def entry_id(source: Column, name: Column) -> Column:
    """Version-5 UUID of ``source:name`` in the URL namespace."""
    text = F.encode(F.concat_ws(":", source, name), "UTF-8")
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE_HEX)), text))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def iso_timestamp(ts: Column) -> Column:
    """ISO 8601 text in UTC; the fraction is left out when it is zero."""
    # Most times have no fraction: a number says so at a tenth of what its text costs.
    whole = F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(1_000_000)) == 0
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(whole, F.lit("")).otherwise(F.concat(F.lit("."), F.date_format(ts, "SSSSSS"))),
        F.lit("+00:00"),
    )


def row_hash_prefix(
    tenant_id: Column,
    case_id: Column,
    event_type: Column,
    actor: Column,
    model_version: Column,
    input_hash: Column,
    payload: Column,
    created_at: Column,
) -> Column:
    """Everything of an audit row that is hashed, up to where the previous hash goes.

    Nulls become empty text: ``concat_ws`` would drop them and shift the later fields.
    """
    fields = [tenant_id, case_id, event_type, actor, model_version, input_hash, payload]
    texts = [F.coalesce(f.cast("string"), F.lit("")) for f in fields]
    return F.concat_ws(FIELD_SEPARATOR, *texts, iso_timestamp(created_at), F.lit(""))


def row_hash(prefix: Column, prev_row_hash: Column) -> Column:
    return F.sha2(F.concat(prefix, F.coalesce(prev_row_hash, F.lit(""))), 256)


def _xor_block(block_hex: Column, pad: int) -> Column:
    # 64-byte block as 16 words of 4 bytes: a word fits a bigint, so XOR stays exact.
    words = [
        F.lpad(
            F.lower(
                F.hex(
                    F.conv(F.substring(block_hex, 8 * i + 1, 8), 16, 10)
                    .cast("bigint")
                    .bitwiseXOR(F.lit(pad * 0x01010101))
                )
            ),
            8,
            "0",
        )
        for i in range(16)
    ]
    return F.unhex(F.concat(*words))


def hmac_pads(secret: Column) -> Column:
    """Inner and outer key blocks of HMAC-SHA256; computed once per secret, not once per message."""
    raw = F.encode(secret, "UTF-8")
    key = F.when(F.octet_length(raw) > 64, F.unhex(F.sha2(raw, 256))).otherwise(raw)
    block = F.rpad(F.lower(F.hex(key)), 128, "0")
    return F.struct(_xor_block(block, 0x36).alias("inner"), _xor_block(block, 0x5C).alias("outer"))


def hmac_sha256(pads: Column, message: Column) -> Column:
    inner = F.unhex(F.sha2(F.concat(pads["inner"], F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(pads["outer"], inner), 256)


def json_text(value: Column) -> Column:
    """A JSON string literal restricted to ASCII; null becomes ``null``.

    Text without anything to escape takes the short way; the rest is escaped character by character.
    """
    plain = value.rlike(r"^[ !#-\[\]-~]*\z")
    escapes = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}

    def escape(ch: Column) -> Column:
        out = None
        for raw, text in escapes.items():
            out = F.when(ch == raw, F.lit(text)) if out is None else out.when(ch == raw, F.lit(text))
        utf16 = F.lower(F.hex(F.encode(ch, "UTF-16BE")))
        return out.when(ch.rlike(r"^[ -~]$"), ch).otherwise(
            F.regexp_replace(utf16, "(....)", r"\\u$1")
        )

    chars = F.filter(F.split(value, ""), lambda ch: ch != "")
    escaped = F.array_join(F.transform(chars, escape), "")
    body = F.when(plain, value).otherwise(escaped)
    return F.when(value.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), body, F.lit('"')))


def json_number(value: Column) -> Column:
    """JSON text of a score with at most four decimals, with at least one decimal digit."""
    text = F.regexp_replace(numeric_5_4(value).cast("string"), r"(\.\d+?)0+$", "$1")
    return F.coalesce(text, F.lit("null"))


def json_integer(value: Column) -> Column:
    return F.coalesce(value.cast("bigint").cast("string"), F.lit("null"))


def json_texts(values: Column) -> Column:
    """A JSON array of texts; a null array is empty."""
    items = F.transform(F.coalesce(values, F.array().cast("array<string>")), json_text)
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def json_bool(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("null")).when(value, F.lit("true")).otherwise(F.lit("false"))


def json_object(**members: Column) -> Column:
    """Canonical object text: members sorted by key, ``", "`` and ``": "`` as separators."""
    return ordered_json_object([(k, members[k]) for k in sorted(members)])


def ordered_json_object(members: list[tuple[str, Column]]) -> Column:
    parts = []
    for key, text in members:
        parts += [F.lit(f'{", " if parts else "{"}"{key}": '), text]
    return F.concat(*parts, F.lit("}"))
