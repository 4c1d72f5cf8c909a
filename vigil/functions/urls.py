"""Webhook URL screening (notification channels)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.labels import trim_space

URL_MAX = 512
_OCTET = r"(0|[1-9][0-9]{0,2})"
_V4 = "^" + r"\.".join([_OCTET] * 4) + "$"
_V4_TAIL = "^(.*:)" + r"\.".join([_OCTET] * 4) + "$"


def _restricted_octets(o: list[Column]) -> Column:
    return ((o[0] == 127) | (o[0] == 10) | ((o[0] == 172) & o[1].between(16, 31))
            | ((o[0] == 192) & (o[1] == 168)) | ((o[0] == 169) & (o[1] == 254))
            | o[0].between(224, 239) | ((o[0] == 0) & (o[1] == 0) & (o[2] == 0) & (o[3] == 0)))


def _let(c: Column, f) -> Column:
    """``f(c)`` with ``c`` evaluated once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _is_v4(o: Column) -> Column:
    return F.forall(o, lambda x: x.isNotNull() & (x <= 255))


def _four(o: Column) -> list[Column]:
    return [F.get(o, F.lit(i)) for i in range(4)]


def _restricted_v4(host: Column) -> Column:
    """A dotted address (no leading zeros, each part at most 255) of a restricted range."""
    return F.coalesce(_let(F.array(*[F.regexp_extract(host, _V4, i).try_cast("int") for i in (1, 2, 3, 4)]),
                           lambda o: _is_v4(o) & _restricted_octets(_four(o))), F.lit(False))


def _restricted_v6(host: Column) -> Column:
    """A bracketed IPv6 address, in any spelling, of a restricted range; mapped IPv4 addresses count as such."""
    def untail(h: Column) -> Column:  # a dotted tail as two groups
        q = F.array(*[F.regexp_extract(h, _V4_TAIL, i).try_cast("int") for i in (2, 3, 4, 5)])
        return _let(q, lambda o: F.when(_is_v4(o), F.concat(
            F.regexp_extract(h, _V4_TAIL, 1), F.lower(F.hex(F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1)))), F.lit(":"),
            F.lower(F.hex(F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3)))))).otherwise(h))

    def groups(c: Column) -> Column:
        return F.filter(F.split(F.coalesce(c, F.lit("")), ":"), lambda x: x != "")

    def expand(halves: Column) -> Column:  # zeros for ::
        both = F.concat(groups(F.get(halves, F.lit(0))), groups(F.get(halves, F.lit(1))))
        zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(both), F.lit(0)))
        return F.when(F.size(halves) == 2, F.concat(groups(F.get(halves, F.lit(0))), zeros, groups(F.get(halves, F.lit(1)))))\
            .when(F.size(halves) == 1, both)

    def judge(g: Column) -> Column:
        at = [F.get(g, F.lit(i)) for i in range(8)]
        zeros = F.forall(F.slice(g, 1, 5), lambda x: x == 0)
        mapped = [F.shiftright(at[6], 8), at[6].bitwiseAND(255), F.shiftright(at[7], 8), at[7].bitwiseAND(255)]
        return (F.size(g) == 8) & F.forall(g, lambda x: x.isNotNull()) & (
            (zeros & (at[5] == 0) & (at[6] == 0) & (at[7] <= 1)) | (zeros & (at[5] == 0xFFFF) & _restricted_octets(mapped))
            | (at[0].bitwiseAND(0xFE00) == 0xFC00) | (at[0].bitwiseAND(0xFFC0) == 0xFE80) | (at[0].bitwiseAND(0xFF00) == 0xFF00))

    def numbers(full: Column) -> Column:
        return F.transform(full, lambda x: F.when(x.rlike("^[0-9a-f]{1,4}$"), F.conv(x, 16, 10).try_cast("int")))

    h = F.regexp_replace(F.regexp_replace(host, r"^\[|\]$", ""), "%.*$", "")
    tailed = _let(h, untail)
    return host.contains(":") & F.coalesce(_let(F.split(tailed, "::"), lambda x: _let(expand(x), lambda f: _let(numbers(f), judge))), F.lit(False))


def url_reason(url: Column) -> Column:
    """First failing rule of the channel URL screen, NULL when acceptable: 1-512 bytes, a URL at
    all, http(s) only, a host, no user info, not localhost and not a loopback / private /
    unspecified / link-local / multicast IP literal. The reason texts are fixed values."""
    u = trim_space(url)
    scheme = F.lower(F.try_parse_url(u, F.lit("PROTOCOL")))
    authority = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", "")
    parsed = F.try_parse_url(u, F.lit("PATH")).isNotNull() | u.rlike("^[A-Za-z][A-Za-z0-9+.-]*:[^/]")
    h = F.regexp_replace(F.lower(host), r"\.$", "")
    restricted = _let(h, lambda x: (x == "localhost") | x.endswith(".localhost") | (x == "0") | _restricted_v4(x) | _restricted_v6(x))
    return (F.when((F.octet_length(u) == 0) | (F.octet_length(u) > URL_MAX), "url must be 1-512 characters")
            .when(~parsed, "invalid url")
            .when(~F.coalesce(scheme.isin("http", "https"), F.lit(False)), "url scheme must be http or https")
            .when(h == "", "url host is required")
            .when(authority.contains("@"), "url user info is not allowed")
            .when(restricted, "url host is restricted"))


def channels_screen(channels: DataFrame) -> DataFrame:
    """Batch screen of a channel table: trimmed name (1-128 bytes), type defaults to
    ``webhook`` (the only one supported), URL rules; ``reason`` is NULL when valid."""
    c = channels
    name = trim_space(F.coalesce("name", F.lit("")))
    typ = trim_space(F.coalesce("type", F.lit("")))
    typ = F.when(typ == "", "webhook").otherwise(typ)
    reason = (F.when((F.octet_length(name) == 0) | (F.octet_length(name) > 128), "name must be 1-128 characters")
              .when(typ != "webhook", "unsupported notification channel type")
              .otherwise(url_reason(F.col("url"))))
    return c.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())
