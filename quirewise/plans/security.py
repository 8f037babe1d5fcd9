"""Sanitizing, protection and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewise.functions.patterns import NAMED_PATTERNS
from quirewise.operators import protect as prot
from quirewise.operators import sanitize as ops
from quirewise.operators.redact import pii_mask
from quirewise.plans.tables import ANNOTATIONS, Tables, query, with_

PATTERNS = list(NAMED_PATTERNS)


def _passwords(t: Tables) -> DataFrame:
    """A user password for every document of a language, an owner password for some sources."""
    return t.documents.select(
        "doc_id",
        F.when(F.col("lang") != "fr", F.concat(F.lit("user-"), F.col("doc_id"))).alias("user_password"),
        F.when(F.col("source") == "src1", F.concat(F.lit("owner-"), F.col("doc_id"))).alias("owner_password"),
    )


def _round_trip(t: Tables) -> DataFrame:
    """Protect, protect again, then unlock: with the owner password where there is one, wrongly for one source."""
    secrets = _passwords(t)
    locked = prot.protect(t.documents, secrets)
    again = prot.protect(locked.drop("error"), secrets)
    tried = secrets.join(t.documents.select("doc_id", "source"), "doc_id").select(
        "doc_id",
        F.when(F.col("source") == "src2", "guess").otherwise(F.coalesce("owner_password", "user_password")).alias(
            "password"
        ),
    )
    opened = prot.unprotect(locked, tried).select("doc_id", "text", F.col("error").alias("unlock_error"))
    return (
        again.select("doc_id", F.col("error").alias("protect_error"), F.col("cipher").isNotNull().alias("locked"))
        .join(opened, "doc_id")
        .select("doc_id", "locked", "protect_error", "unlock_error", "text")
    )


def _manifest(t: Tables) -> DataFrame:
    """Digests of the documents but those of one source; one source signed under ids that do not exist."""
    shifted = F.when(F.col("source") == "src4", -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("doc_id")
    signed = t.documents.where("source <> 'src3'")
    return prot.digest_manifest(signed.select(shifted, "text"))


def _certify(t: Tables) -> DataFrame:
    """Two requests per document, the first with permissions 0 to 4; one source is signed already."""
    doc = t.documents
    requests = doc.select(
        "doc_id",
        F.explode(
            F.array(
                F.struct(F.lit(1).cast("bigint").alias("ord"), (F.col("doc_id") % 5).alias("permission")),
                F.struct(F.lit(2).cast("bigint").alias("ord"), F.lit(2).cast("bigint").alias("permission")),
            )
        ).alias("_r"),
    ).select("doc_id", "_r.*")
    signed = prot.digest_manifest(doc.where("source = 'src5'"))
    return prot.certify(requests, signed, doc)


QUERIES = {
    "sanitize": query(
        lambda t: ops.sanitize(t.pages, scripts=True, embedded=True, metadata=True, links=True).select("page_id", "html")
    ),
    "sanitize_links": query(lambda t: ops.sanitize(t.pages, links=True).select("page_id", "html")),
    "strip_link_annotations": query(
        lambda t: ops.strip_link_annotations(t.annotations).select("doc_id", "page", "ord", "subtype", "contents")
    ),
    "sanitize_report": query(lambda t: ops.sanitize_report(t.pages)),
    "protect": query(_round_trip),
    "digest_manifest": query(lambda t: prot.digest_manifest(t.documents)),
    "verify_manifest": query(lambda t: prot.verify_manifest(_manifest(t), pii_mask(t.documents, PATTERNS))),
    "certify": query(_certify),
}


def _marked(pattern: str) -> str:
    return rf"regexp_matches(text, '{pattern}')"


_HAS_PII = " OR ".join(_marked(p) for p in NAMED_PATTERNS.values())
_SQL_SCRIPTS = r"(?is)<script\b[^>]*>.*?(?:</script\b[^>]*>|\z)"
_NO_SCRIPT = r"regexp_replace(html, '(?is)<script\b.*?</script>', '', 'g')"
_NO_EMBED = rf"regexp_replace({_NO_SCRIPT}, '(?is)<iframe\b.*?</iframe>|<object\b.*?</object>|<embed\b[^>]*>', '', 'g')"
_NO_META = rf"regexp_replace({_NO_EMBED}, '(?is)<title\b.*?</title>|<meta\b[^>]*>', '', 'g')"




def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(html, '{pattern}'))::BIGINT"


ORACLES = {
    "sanitize": rf"SELECT page_id, regexp_replace({_NO_META}, '(?is)<a\b[^>]*>|</a>', '', 'g') AS html FROM pages",
    "sanitize_links": r"SELECT page_id, regexp_replace(html, '(?is)<a\b[^>]*>|</a>', '', 'g') AS html FROM pages",
    "strip_link_annotations": with_(ANNOTATIONS)
    + "SELECT doc_id, page, ord, subtype, contents FROM annotations WHERE subtype <> 'Link'",
    "sanitize_report": f"""SELECT page_id, {_count(_SQL_SCRIPTS)} AS scripts, {_count(ops.EMBEDDED)} AS embedded,
  coalesce(list_sum(list_transform(regexp_extract_all({_NO_SCRIPT}, '<[a-zA-Z][^<>]*>'),
    lambda t: len(regexp_extract_all(t, '(?i)[ /]on[a-z]+ *=')))), 0)::BIGINT AS handlers,
  {_count(ops.HEAD_DATA)} AS metadata, {_count(ops.LINKS)} AS links FROM pages""",
    "protect": """SELECT doc_id, lang <> 'fr' AND text IS NOT NULL AS locked,
  CASE WHEN lang <> 'fr' AND text IS NOT NULL THEN 'document is already protected' END AS protect_error,
  CASE WHEN lang <> 'fr' AND text IS NOT NULL AND source = 'src2' THEN 'wrong password' END AS unlock_error,
  CASE WHEN lang <> 'fr' AND source = 'src2' THEN NULL ELSE text END AS text FROM documents""",
    "digest_manifest": "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents",
    "verify_manifest": f"""WITH now_ AS (SELECT doc_id, {_HAS_PII} AS changed FROM documents),
signed AS (SELECT CASE WHEN source = 'src4' THEN -doc_id - 1 ELSE doc_id END AS doc_id FROM documents
  WHERE source <> 'src3')
SELECT doc_id, CASE WHEN n.doc_id IS NULL THEN 'missing' WHEN s.doc_id IS NULL THEN 'unsigned'
  WHEN changed THEN 'tampered' ELSE 'valid' END AS status
FROM signed s FULL JOIN now_ n USING (doc_id)""",
    "certify": """WITH requests AS (
  SELECT doc_id, source, text, ord, CASE WHEN ord = 1 THEN doc_id % 5 ELSE 2 END AS permission
  FROM documents, (VALUES (1::BIGINT), (2)) o(ord)),
judged AS (
  SELECT *, CASE WHEN permission NOT BETWEEN 1 AND 3 THEN 'permission ' || permission || ' is not 1, 2 or 3'
    WHEN source = 'src5' OR (ord = 2 AND doc_id % 5 BETWEEN 1 AND 3) THEN 'document is already signed' END AS error
  FROM requests)
SELECT doc_id, ord, permission::BIGINT AS permission, CASE WHEN error IS NULL THEN sha256(coalesce(text, '')) END AS digest,
  error FROM judged""",
}
