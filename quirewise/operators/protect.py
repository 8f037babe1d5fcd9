"""Password protection of text, and digests that reveal later changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewise.operators.spread import spread_join

ALREADY_PROTECTED = "document is already protected"
WRONG_PASSWORD = "wrong password"
ALREADY_SIGNED = "document is already signed"


def _password_key(password: Column) -> Column:
    return F.unhex(F.sha2(password, 256))


def protect(documents: DataFrame, passwords: DataFrame) -> DataFrame:
    """Encrypt the text of documents; ``passwords(doc_id, user_password, owner_password)``.

    A content key made of both passwords encrypts the text; either password unlocks that key. The owner password
    defaults to the user password. Keys come from a table, so no plan holds one. A document that is protected
    already gets an error and stays as it is; one without a password passes through.
    """
    has_state = "cipher" in documents.columns
    state = F.col("cipher").isNotNull() if has_state else F.lit(False)
    user = F.col("user_password")
    owner = F.coalesce("owner_password", "user_password")
    content_key = F.unhex(F.sha2(F.concat_ws("\u0000", user, owner, F.col("doc_id").cast("string")), 256))
    ready = user.isNotNull() & ~state
    joined = documents.join(passwords.select("doc_id", "user_password", "owner_password"), "doc_id", "left")
    keep = lambda name, kind: F.col(name) if has_state else F.lit(None).cast(kind)
    new = {
        "cipher": F.when(ready, F.aes_encrypt(F.col("text"), content_key, F.lit("GCM"))).otherwise(
            keep("cipher", "binary")
        ),
        "user_lock": F.when(ready, F.aes_encrypt(content_key, _password_key(user), F.lit("GCM"))).otherwise(
            keep("user_lock", "binary")
        ),
        "owner_lock": F.when(ready, F.aes_encrypt(content_key, _password_key(owner), F.lit("GCM"))).otherwise(
            keep("owner_lock", "binary")
        ),
        "text": F.when(ready, F.lit(None).cast("string")).otherwise(F.col("text")),
        "error": F.when(user.isNotNull() & state, F.lit(ALREADY_PROTECTED)),
    }
    return joined.withColumns(new).drop("user_password", "owner_password")


def unprotect(protected: DataFrame, passwords: DataFrame) -> DataFrame:
    """Decrypt with the user or the owner password; ``passwords(doc_id, password)``.

    A plain document passes through; a wrong password gives an error, never garbage.
    """
    locked = F.col("cipher").isNotNull()
    key = _password_key(F.col("password"))
    content_key = F.coalesce(
        F.try_aes_decrypt("user_lock", key, F.lit("GCM")), F.try_aes_decrypt("owner_lock", key, F.lit("GCM"))
    )
    plain = F.try_aes_decrypt("cipher", content_key, F.lit("GCM")).cast("string")
    return (
        protected.drop("error")
        .join(passwords.select("doc_id", "password"), "doc_id", "left")
        .withColumn("text", F.when(locked, plain).otherwise(F.col("text")))
        .withColumn("error", F.when(locked & F.col("text").isNull(), F.lit(WRONG_PASSWORD)))
        .drop("password", "cipher", "user_lock", "owner_lock")
    )


def digest_manifest(documents: DataFrame, column: str = "text") -> DataFrame:
    """SHA-256 per document over its text; a signature beside the text is no part of it."""
    return documents.select("doc_id", F.sha2(F.coalesce(column, F.lit("")), 256).alias("digest"))


def verify_manifest(manifest: DataFrame, documents: DataFrame, column: str = "text") -> DataFrame:
    """Recompute and compare: valid, tampered, missing (signed, no document) or unsigned."""
    signed = manifest.select("doc_id", F.col("digest").alias("_signed"))
    now = digest_manifest(documents, column).withColumnRenamed("digest", "_now")
    status = (
        F.when(F.col("_now").isNull(), "missing")
        .when(F.col("_signed").isNull(), "unsigned")
        .when(F.col("_signed") == F.col("_now"), "valid")
        .otherwise("tampered")
    )
    return signed.join(now, "doc_id", "full").select("doc_id", status.alias("status"))


def certify(requests: DataFrame, manifest: DataFrame, documents: DataFrame) -> DataFrame:
    """Sign documents once: ``requests(doc_id, ord, permission)``.

    The permission must be 1 to 3. A document signed before, or by an earlier valid request, is refused.
    """
    in_range = F.coalesce(F.col("permission").between(1, 3), F.lit(False))
    first = requests.where(in_range).groupBy("doc_id").agg(F.min("ord").alias("_first"))
    signed = manifest.select("doc_id").distinct().withColumn("_signed", F.lit(True))
    # One row per document first, so that a document with very many requests is joined once and can be spread.
    known = digest_manifest(documents).join(first, "doc_id", "left").join(signed, "doc_id", "left")
    error = (
        F.when(
            ~in_range,
            F.concat(F.lit("permission "), F.coalesce(F.col("permission").cast("string"), F.lit("null")), F.lit(" is not 1, 2 or 3")),
        )
        .when(F.col("digest").isNull(), F.lit("document does not exist"))
        .when(F.col("_signed") | (F.col("ord") > F.col("_first")), F.lit(ALREADY_SIGNED))
    )
    return (
        spread_join(requests, known, ["doc_id"], salt_by=["ord"], how="left")
        .withColumn("error", error)
        .select(
            "doc_id", "ord", "permission", F.when(F.col("error").isNull(), F.col("digest")).alias("digest"), "error"
        )
    )
