"""URL, HTML, robots and charset functions. All but charset detection are column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .analysis import let

DROPPED = r"(?is)<(script|style|noscript|svg|template)\b[^>]*>.*?</\1>"
COMMENTS = r"(?s)<!--.*?-->"
LINKS = r"(?is)<a[^>]*href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
BLOCKS = r"(?i)</?(?:p|div|li|ul|ol|br|hr|h[1-6]|tr|td|table|article|section|header|footer|blockquote|pre|dd|dt|main|figure)[^>]*>"
TAGS = r"<[^>]+>"
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"))
ON, OFF = "\x01", "\x02"


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def unescape(text: Column) -> Column:
    """Seven named entities in order, then numeric references."""
    for a, b in ENTITIES:
        text = F.replace(text, F.lit(a), F.lit(b))
    refs = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#(?:[0-9]{1,6}|x[0-9a-fA-F]{1,6});"), F.lit(0)))

    def put(state: Column, ref: Column) -> Column:
        code = F.when(ref.startswith("&#x"), F.conv(F.regexp_extract(ref, "x([0-9a-fA-F]+)", 1), 16, 10)).otherwise(F.regexp_extract(ref, "([0-9]+)", 1)).cast("int")
        utf16 = F.when(code < 0x10000, F.lpad(F.hex(code), 4, "0")).otherwise(F.concat(F.lpad(F.hex(F.lit(0xD800) + F.shiftright(code - 0x10000, 10)), 4, "0"), F.lpad(F.hex(F.lit(0xDC00) + (code - 0x10000).bitwiseAND(F.lit(0x3FF))), 4, "0")))
        valid = (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(valid, F.replace(state, ref, F.decode(F.unhex(utf16), "UTF-16BE"))).otherwise(state)

    return F.when(F.size(refs) > 0, F.aggregate(refs, text, put)).otherwise(text)


def clean(fragment: Column) -> Column:
    return squeezed(unescape(F.regexp_replace(fragment, TAGS, " ")))


def stripped_page(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), COMMENTS, " "), DROPPED, " ")


def page_title(doc: Column) -> Column:
    title = clean(F.regexp_extract(doc, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.when(title != "", title).otherwise(clean(F.regexp_extract(doc, r"(?is)<h1[^>]*>(.*?)</h1>", 1)))


def page_description(doc: Column) -> Column:
    first = F.regexp_extract(doc, r"(?is)<meta[^>]+name=[\"']description[\"'][^>]+content=[\"'](.*?)[\"']", 1)
    second = F.regexp_extract(doc, r"(?is)<meta[^>]+content=[\"'](.*?)[\"'][^>]+name=[\"']description[\"']", 1)
    return clean(F.when(first != "", first).otherwise(second))


def page_hrefs(doc: Column) -> Column:
    """array<string>: hrefs of anchors that lead somewhere."""
    found = F.transform(F.regexp_extract_all(doc, F.lit(LINKS), F.lit(1)), lambda h: F.trim(h))
    return F.filter(found, lambda h: (h != "") & ~h.startswith("#") & ~F.lower(h).startswith("javascript:"))


def resolved(base: Column, href: Column) -> Column:
    """href against base: absolute, scheme-relative, rooted, query-only and relative forms; dot segments are removed."""
    scheme, root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(path, r"^(.*/)", 1)

    def flat(p: Column) -> Column:
        parts = F.aggregate(F.split(F.regexp_extract(p, r"^([^?#]*)", 1), "/", -1), F.array().cast("array<string>"), lambda s, x: F.when(x == ".", s).when(x == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(1)))).otherwise(F.concat(s, F.array(x))))
        tail = F.when(p.rlike(r"^[^?#]*(^|/)\.\.?([?#]|$)"), F.lit("/")).otherwise(F.lit(""))
        return F.concat(F.array_join(parts, "/"), tail, F.regexp_extract(p, r"^[^?#]*(.*)$", 1))

    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(root, flat(href)))
        .when(href.startswith("?"), F.concat(root, path, href))
        .otherwise(F.concat(root, flat(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), href))))
    )


def main_text(doc: Column) -> Column:
    """The run of lines with most prose. Lines are cut at block tags; a line is linky if over half of its characters are
    in links or it is under 12 characters; linky lines end a run; lines under 2 characters are passed over. Ties go to
    fewer lines, then to the earlier run. One pass over the lines of a page, without a shuffle."""
    anchors = F.transform(F.regexp_extract_all(doc, F.lit(LINKS), F.lit(2)), lambda a: F.concat(F.lit(ON), clean(a), F.lit(OFF)))
    gaps = F.split(doc, LINKS, -1)
    together = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(anchors, i), F.lit("")))), "")
    raw = F.split(F.regexp_replace(F.regexp_replace(together, BLOCKS, "\n"), TAGS, " "), "\n")

    def line(r: Column) -> Column:
        text = squeezed(F.translate(r, ON + OFF, "  "))
        linked = F.length(F.regexp_replace(F.array_join(F.regexp_extract_all(r, F.lit(f"{ON}([^{OFF}]*)"), F.lit(1)), ""), r"\s", ""))
        return F.struct(text.alias("t"), linked.alias("l"), F.length(text).alias("n"))

    lines = F.filter(F.transform(raw, line), lambda x: x["n"] >= 2)
    zero = F.struct(F.lit(0).alias("prose"), F.lit(0).alias("count"), F.lit("").alias("text"), F.lit(-1).alias("best"), F.lit(0).alias("best_count"), F.lit("").alias("best_text"))

    def closed(s: Column) -> Column:
        better = (s["count"] > 0) & ((s["prose"] > s["best"]) | ((s["prose"] == s["best"]) & (s["count"] < s["best_count"])))
        pick = lambda a, b: F.when(better, s[a]).otherwise(s[b])
        return F.struct(F.lit(0).alias("prose"), F.lit(0).alias("count"), F.lit("").alias("text"), pick("prose", "best").alias("best"), pick("count", "best_count").alias("best_count"), pick("text", "best_text").alias("best_text"))

    def step(s: Column, x: Column) -> Column:
        linky = (x["l"] > 0.5 * x["n"]) | (x["n"] < 12)
        more = F.struct((s["prose"] + x["n"] - F.least(x["l"], x["n"])).alias("prose"), (s["count"] + 1).alias("count"), F.when(s["count"] == 0, x["t"]).otherwise(F.concat(s["text"], F.lit("\n"), x["t"])).alias("text"), s["best"], s["best_count"], s["best_text"])
        return F.when(linky, closed(s)).otherwise(more)

    return F.aggregate(lines, zero, step, lambda s: closed(s)["best_text"])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, title, body, links, description of pages (page_id, url, html)."""
    rows = pages.select("page_id", "url", stripped_page(F.col("html")).alias("doc"))
    rows = rows.select("page_id", "url", page_title(F.col("doc")).alias("title"), main_text(F.col("doc")).alias("body"), F.transform(page_hrefs(F.col("doc")), lambda h: resolved(F.col("url"), h)).alias("links"), page_description(F.col("doc")).alias("description"))
    return rows.withColumn("body", F.when(F.trim("body") == "", F.col("description")).otherwise(F.col("body")))


def normalized_url(url: Column) -> Column:
    """No fragment; scheme and authority lower-cased; query parts sorted; default ports and closing slashes removed."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(u, "^(.*?://)", 1))
    rest = F.regexp_replace(u, "^.*?://", "")
    authority = F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/]*)", 1)), ":(80|443)$", "")
    path, query = F.regexp_extract(rest, r"^[^/]*(/[^?]*)", 1), F.regexp_extract(rest, r"^[^/]*/[^?]*\?(.*)$", 1)
    parts = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: x != "")), "&")
    query = F.when(parts != "", F.concat(F.lit("?"), parts)).otherwise(F.lit(""))
    path = F.when(path.rlike("^/+$"), F.lit("/")).otherwise(F.regexp_replace(path, "/+$", ""))
    return F.concat(scheme, authority, path, query)


def url_fingerprint(url: str) -> int:
    """FNV-1a, 64 bits, over UTF-16 units of the normalised url."""
    h, data = 0xCBF29CE484222325, url.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(data), 2):
        h = (h ^ int.from_bytes(data[i : i + 2], "little")) * 0x100000001B3 % 2**64
    return h


def _number(part: Column) -> Column:
    """A part of an address in decimal, 0x hexadecimal or 0 octal notation; null if it is none or too large to tell."""
    hexa = F.when(F.length(part) <= 12, F.conv(F.concat(F.lit("0"), F.substring(part, 3, 12)), 16, 10))
    octal = F.when(F.length(part) <= 16, F.conv(part, 8, 10))
    plain = F.when(F.length(part) <= 12, part)
    return F.when(part.rlike("^0x[0-9a-f]*$"), hexa).when(part.rlike("^0[0-7]+$"), octal).when(part.rlike("^[0-9]+$"), plain).try_cast("long")


def ipv4_number(host: Column) -> Column:
    """The 32-bit address of a host in any of the notations that resolvers take (1 to 4 parts, the last of which fills
    what is left); -1 for numeric hosts that are no address; null for names."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    numeric = host.rlike(r"^(0x[0-9a-f]*|[0-9]+)(\.(0x[0-9a-f]*|[0-9]+))*$")
    last = _number(F.element_at(parts, -1))
    value, good = last, (n <= 4) & (last >= 0)
    for i in range(3):
        own = _number(F.get(parts, F.lit(i)))
        value = value + F.when(n > i + 1, F.shiftleft(own, 24 - 8 * i)).otherwise(F.lit(0))
        good = good & ((n <= i + 1) | own.between(0, 255))
    room = F.when(n == 1, 2**32).when(n == 2, 2**24).when(n == 3, 2**16).otherwise(2**8)
    return F.when(numeric, F.when(F.coalesce(good & (last < room), F.lit(False)), value).otherwise(F.lit(-1)))


def ipv4_in_ipv6(host: Column) -> Column:
    """The IPv4 address that a bracketed IPv6 host maps, embeds or translates to, else null."""
    mapped = r"^\[(?:(?:0*:)*:?(?:ffff:(?:0+:)?)?|64:ff9b::)"
    dotted = F.regexp_extract(host, mapped + r"([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)\]$", 1)
    pair = mapped + r"([0-9a-f]{1,4}):([0-9a-f]{1,4})\]$"
    six = r"^\[2002:([0-9a-f]{1,4}):([0-9a-f]{1,4})[:\]]"
    joined = lambda rx: F.shiftleft(F.conv(F.regexp_extract(host, rx, 1), 16, 10).cast("long"), 16) + F.conv(F.regexp_extract(host, rx, 2), 16, 10).cast("long")
    return F.when(dotted != "", ipv4_number(dotted)).when(host.rlike(pair), joined(pair)).when(host.rlike(six), joined(six))


def target_reason(url: Column) -> Column:
    """Why a url may not be fetched, judged by its literal text in all notations of an address; null if it may. Names are
    judged again by what they resolve to where they are fetched (`sources.fetch`)."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/?#]*@)?(\[[^\]]*\]|[^:/?#@]*)", 1))

    # the reasons are fixed values: clients and logs read their wording
    def judged(x: Column) -> Column:
        host, v4, a, b = x["host"], x["v4"], F.shiftright(x["v4"], 24), F.shiftright(x["v4"], 16).bitwiseAND(F.lit(255))
        return (
            F.when(host == "", "url has no host")
            .when(v4 == -1, "malformed url")
            .when((host == "localhost") | host.endswith(".localhost") | (a == 127) | host.rlike(r"^\[(0*:)*:?0*1\]$"), "loopback target")
            .when((v4 == 0) | host.rlike(r"^\[[0:]+\]$"), "unspecified address")
            .when((a == 169) & (b == 254) | host.rlike(r"^\[fe[89ab]"), "link-local target")
            .when((a == 10) | (a == 172) & b.between(16, 31) | (a == 192) & (b == 168) | host.rlike(r"^\[fe[cdef]"), "private network target")
            .when(a.between(224, 239) | host.rlike(r"^\[ff"), "multicast target")
            .when(host.rlike(r"^\[f[cd]"), "unique local address")
            .when((a == 100) & b.between(64, 127), "carrier-grade NAT range")
            .when(a == 0, "0.0.0.0/8")
            .when(a >= 240, "reserved address")
        )

    found = let(F.regexp_replace(host, r"\.$", ""), lambda h: F.struct(h.alias("host"), F.coalesce(ipv4_number(h), ipv4_in_ipv6(h)).alias("v4")))
    return F.when(url.isNull() | url.rlike(r"[\s\\]"), "malformed url").when(~F.lower(url).rlike("^https?:"), "only http(s) targets are crawled").otherwise(let(found, judged))


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """(host, rule_no, allow, path) of files (host, robots_txt) that hold for an agent."""
    own = agent.lower()

    def step(s: Column, raw: Column) -> Column:
        text = F.trim(raw)
        key, value = F.lower(F.trim(F.regexp_extract(text, "^([^:]*):", 1))), F.trim(F.regexp_replace(text, "^[^:]*:", ""))
        agent_of = F.lower(value)
        meant = (agent_of == "*") | F.lit(own).startswith(agent_of) | agent_of.startswith(own)
        skipped = (text == "") | text.startswith("#") | ~text.contains(":")
        rule = F.struct((key == "allow").alias("allow"), value.alias("path"))
        new = s["on"] & (value != "") & ((key == "allow") | (key == "disallow") & ~F.exists(s["rules"], lambda r: r["path"] == value))
        on = F.when(~skipped & (key == "user-agent"), meant).otherwise(s["on"])
        return F.struct(on.alias("on"), F.when(~skipped & new, F.concat(s["rules"], F.array(rule))).otherwise(s["rules"]).alias("rules"))

    zero = F.struct(F.lit(False).alias("on"), F.array().cast("array<struct<allow:boolean,path:string>>").alias("rules"))
    rules = F.aggregate(F.split(F.coalesce("robots_txt", F.lit("")), r"\R"), zero, step, lambda s: s["rules"])
    return files.select("host", F.posexplode(rules).alias("rule_no", "r")).select("host", "rule_no", "r.allow", "r.path")


def crawl_delays(files: DataFrame, agent: str) -> DataFrame:
    """(host, delay): the last Crawl-delay in seconds of files (host, robots_txt) that holds for an agent, 0 without one."""
    own = agent.lower()

    def step(s: Column, raw: Column) -> Column:
        key, value = F.lower(F.trim(F.regexp_extract(raw, "^([^:#]*):", 1))), F.trim(F.regexp_replace(raw, "^[^:]*:", ""))
        meant = (F.lower(value) == "*") | F.lit(own).startswith(F.lower(value)) | F.lower(value).startswith(own)
        told = F.when(s["on"] & (key == "crawl-delay"), value.try_cast("double"))
        return F.struct(F.when(key == "user-agent", meant).otherwise(s["on"]).alias("on"), F.coalesce(told, s["delay"]).alias("delay"))

    zero = F.struct(F.lit(False).alias("on"), F.lit(0.0).alias("delay"))
    return files.select("host", F.aggregate(F.split(F.coalesce("robots_txt", F.lit("")), r"\R"), zero, step, lambda s: F.greatest(s["delay"], F.lit(0.0))).alias("delay"))


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, allowed) of each row of urls (url), a url of several rows as often: of the rules of its host that match by
    prefix or wildcard the longest, then the first."""
    host = F.concat(F.expr("try_parse_url(url, 'HOST')"), F.coalesce(F.regexp_extract("url", r"^[a-zA-Z]+://[^/:?#]*(:[0-9]+)", 1), F.lit("")))
    path = F.concat(F.when(F.coalesce(F.expr("try_parse_url(url, 'PATH')"), F.lit("")) == "", F.lit("/")).otherwise(F.expr("try_parse_url(url, 'PATH')")), F.coalesce(F.concat(F.lit("?"), F.expr("try_parse_url(url, 'QUERY')")), F.lit("")))
    rows = urls.select("url", F.regexp_replace(F.lower(host), ":(80|443)$", "").alias("host"), path.alias("_path"))
    glob = F.concat(F.lit("^\\Q"), F.replace(F.regexp_replace("path", r"\$$", ""), F.lit("*"), F.lit("\\E.*\\Q")), F.lit("\\E$"))
    # the rules of a host are one file's and stand in one row, so the join neither adds rows nor drops any
    listed = rules.groupBy("host").agg(F.collect_list(F.struct("path", glob.alias("glob"), "rule_no", "allow")).alias("_rules"))
    hit = lambda r: F.col("_path").startswith(r["path"]) | (r["path"].contains("*") & F.rlike(F.col("_path"), r["glob"]))
    best = F.array_max(F.transform(F.filter("_rules", hit), lambda r: F.struct(F.length(r["path"]).alias("n"), (-r["rule_no"]).alias("r"), r["allow"].alias("allow"))))
    return rows.join(listed, "host", "left").select("url", F.coalesce(best["allow"], F.lit(True)).alias("allowed"))


def decoded(body: bytes, content_type: str | None) -> str:
    """By BOM, header, a charset named in the first 4096 bytes, strict UTF-8, and else GBK."""
    import re

    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace")
    for text in (content_type or "", body[:4096].decode("latin-1")):
        if m := re.search(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", text, re.I):
            try:
                return body.decode(m[1], "replace")
            except LookupError:
                pass
    try:
        return body.decode("utf-8")
    except UnicodeDecodeError:
        return body.decode("gbk", "replace")


@F.pandas_udf(StringType())
def decode_body(body: pd.Series, content_type: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else decoded(bytes(b), c) for b, c in zip(body, content_type)])
