"""Scans of fetched pages: an offline corpus in place of the network, with the outcome a live fetch would report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup, urls

# Request profiles (user agent, accept-language, accept-encoding, platform).
PROFILES = (
    ("Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/121.0.0.0 Safari/537.36", "en-US,en;q=0.9", "gzip, deflate, br", "Windows"),
    ("Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/121.0.0.0 Safari/537.36", "en-US,en;q=0.9", "gzip, deflate, br", "macOS"),
    ("Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/121.0.0.0 Safari/537.36", "en-US,en;q=0.9", "gzip, deflate, br", "Linux"),
    ("Mozilla/5.0 (Windows NT 10.0; Win64; x64; rv:122.0) Gecko/20100101 Firefox/122.0", "en-US,en;q=0.5", "gzip, deflate, br", "Windows"),
    ("Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.2.1 Safari/605.1.15", "en-US,en;q=0.9", "gzip, deflate, br", "macOS"),
    ("Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/121.0.0.0 Safari/537.36 Edg/121.0.0.0", "en-US,en;q=0.9", "gzip, deflate, br", "Windows"),
)


def profile(n: Column) -> Column:
    """The request profile whose turn it is."""
    each = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("user_agent", "accept_language", "accept_encoding", "platform"), p, strict=True))) for p in PROFILES))
    return F.get(each, F.pmod(n, F.lit(len(PROFILES))).cast("int"))


def fetched(wanted: DataFrame, corpus: DataFrame) -> DataFrame:
    """The wanted URLs (url) with what the corpus (url, html, and status_code, headers if it has them) holds; what it lacks is a connection error with status 0."""
    have = corpus if "status_code" in corpus.columns else corpus.withColumn("status_code", F.lit(200))
    have = have if "server" in have.columns else have.withColumn("server", F.lit(""))
    joined = wanted.select("url").join(have.select("url", "html", "status_code", "server"), "url", "left")
    status = F.coalesce("status_code", F.lit(0))
    reason = markup.blocked_reason(F.coalesce("html", F.lit("")), status, F.coalesce("server", F.lit("")))
    return joined.select(
        "url",
        status.alias("status_code"),
        F.coalesce("html", F.lit("")).alias("html"),
        F.coalesce(F.octet_length("html"), F.lit(0)).alias("content_length"),
        ((status >= 200) & (status < 400)).alias("success"),
        F.when(status == 0, "Connection error: not in the corpus").alias("error"),
        F.when(status > 0, reason).isNotNull().alias("is_blocked"),
        F.when(status > 0, reason).alias("blocked_reason"),
        urls.netloc(F.col("url")).alias("domain"),
    )


def auth_headers(kind: str, secret: str) -> dict[str, str]:
    """Headers of a bearer token or of basic credentials ("user:password")."""
    import base64

    return {"Authorization": f"Bearer {secret}" if kind == "bearer" else "Basic " + base64.b64encode(secret.encode()).decode()}
