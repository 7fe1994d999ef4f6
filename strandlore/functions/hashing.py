"""Content ids and their paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def blob_id(data: Column | str, alg: str = "sha256") -> Column:
    """``alg:hex`` of the raw content (never of its compressed form)."""
    if alg != "sha256":
        raise ValueError(f"unknown hash algorithm {alg!r}; blake3 has its own UDF in functions.blake3")
    return F.concat(F.lit("sha256:"), F.sha2(F.col(data) if isinstance(data, str) else data, 256))


def is_intact(blob: Column, data: Column) -> Column:
    """True where the id matches the bytes; an unknown algorithm is an error."""
    alg = F.substring_index(blob, ":", 1)
    return F.when(alg == "sha256", blob == blob_id(data)).otherwise(
        F.raise_error(F.concat(F.lit("unknown hash algorithm "), alg)).cast("boolean")
    )


def canonical_blob_id(value: Column, default_alg: str = "blake3") -> Column:
    """Base name without ``.blob``; a bare hex name gets the default prefix."""
    base = F.regexp_replace(F.substring_index(value, "/", -1), r"\.blob$", "")
    return F.when(base.contains(":"), base).otherwise(F.concat(F.lit(f"{default_alg}:"), base))


def fanout_path(blob: Column) -> Column:
    """``alg/<2 hex>/<rest>``; null where the hex is shorter than three characters."""
    alg, digest = F.substring_index(blob, ":", 1), F.substring_index(blob, ":", -1)
    return F.when(F.length(digest) >= 3, F.concat_ws("/", alg, F.substring(digest, 1, 2), digest.substr(F.lit(3), F.length(digest))))


def safe_filename(origin: Column) -> Column:
    return F.replace(F.replace(origin, F.lit(":"), F.lit("__")), F.lit("/"), F.lit("_"))


def normal_origin_id(origin: Column) -> Column:
    return F.lower(F.regexp_replace(origin, "^origin:", ""))


def pipeline_hash(*parts: Column) -> Column:
    """sha256 over length-prefixed parts, so that no two part lists collide."""
    framed = [F.concat(F.length(p).cast("string"), F.lit("|"), p) for p in parts]
    return F.sha2(F.concat(*framed), 256)
