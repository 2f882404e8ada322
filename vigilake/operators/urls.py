"""Secrets in URL queries: which parameters of which URLs of a text give something away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parameter names that tell of secrets, and the most of a URL that is looked at.
SECRET_NAMES = ("access_token", "api_key", "apikey", "auth", "authorization", "bearer", "jwt", "key", "passwd", "password", "pwd", "secret", "session_id", "session_token", "token")
URL_BYTES = 2048
_URL = r"(?i)\bhttps?://[^\s<>\"'\x60)\]}]+"


def percent_decoded(s: Column) -> Column:
    """Escapes of printable ASCII; others, and broken ones, stay."""
    parts = F.split(s, "%")
    decoded = F.transform(parts, lambda p, i: F.when((i > 0) & p.rlike("^[2-7][0-9A-Fa-f]"), F.concat(F.decode(F.unhex(F.substring(p, 1, 2)), "UTF-8"), F.substring(p, 3, URL_BYTES))).otherwise(F.when(i > 0, F.concat(F.lit("%"), p)).otherwise(p)))
    return F.array_join(decoded, "")


def value_shape(v: Column) -> Column:
    """JWT before hex before base64-like; null for none of them."""
    core = F.regexp_replace(v, r"={1,2}\z", "")
    separators = F.length(core) - F.length(F.translate(core, "-_", ""))
    base64 = (F.length(v) >= 32) & core.rlike(r"^[A-Za-z0-9+/=_-]+\z") & (separators <= 1) & core.rlike("[0-9]") & core.rlike("[a-z]") & core.rlike("[A-Z]")
    jwt = (F.length(v) >= 20) & v.rlike(r"^[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\z")
    return F.when(jwt, "JWT").when(v.rlike(r"^[0-9A-Fa-f]{32,}\z"), "hex string").when(base64, "base64-like token")


def cut_url(url: Column) -> Column:
    return F.regexp_replace(F.substring(url, 1, URL_BYTES), r"[.,;:!?]+\z", "")


def _pairs(url: Column) -> Column:
    return F.split(F.substring_index(F.regexp_extract(url, r"\?(.*)\z", 1), "#", 1), "&")


def _name(pair: Column) -> Column:
    return F.translate(F.lower(percent_decoded(F.substring_index(pair, "=", 1))), "-. ", "___")


def _value(pair: Column) -> Column:
    return F.when(F.contains(pair, F.lit("=")), F.substring(pair, F.instr(pair, "=") + 1, F.length(pair))).otherwise("")


def _severity(name_hit: Column, shape: Column) -> Column:
    return F.when(name_hit & shape.isNotNull(), 9).when(shape.isNotNull(), 8).when(name_hit, 7).otherwise(0)


def worst(text: Column) -> Column:
    """The highest severity of any query parameter of any URL in the text, within the row; null for none."""

    def decoded(pair: Column) -> Column:
        return F.when(pair != "", F.struct(_name(pair).alias("name"), percent_decoded(_value(pair)).alias("value")))

    # Named step by step, so that no step's expression is written out again in the next.
    pairs = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(_URL), F.lit(0)), lambda u: F.transform(_pairs(cut_url(u)), decoded)))
    shapes = F.transform(pairs, lambda p: F.struct(p["name"].alias("name"), value_shape(p["value"]).alias("shape")))
    found = F.transform(shapes, lambda p: F.when(~p["name"].startswith("utm_"), _severity(p["name"].isin(*SECRET_NAMES), p["shape"])))
    return F.when(F.contains(text, F.lit("?")), F.nullif(F.array_max(found), F.lit(0)))


def parameters(df: DataFrame, text: str) -> DataFrame:
    """A row of each query parameter of each URL in the text (utm_* left out): host, position, name, value, what it shows, severity."""
    url = df.withColumn("url", F.explode(F.regexp_extract_all(text, F.lit(_URL), F.lit(0)))).withColumn("url", cut_url(F.col("url")))
    each = url.withColumn("host", F.substring(F.regexp_extract("url", r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]+)", 1), 1, 80)).select("*", F.posexplode(_pairs(F.col("url"))).alias("position", "pair")).where("pair <> ''")
    found = each.withColumn("name", _name(F.col("pair"))).withColumn("value", _value(F.col("pair"))).where(~F.col("name").startswith("utm_"))
    found = found.withColumn("name_hit", F.col("name").isin(*SECRET_NAMES)).withColumn("shape", value_shape(percent_decoded(F.col("value"))))
    return found.withColumn("severity", _severity(F.col("name_hit"), F.col("shape"))).drop("pair")
