"""Targets that may not be fetched, in every notation, and crawl delays."""

import ipaddress

from pyspark.sql import functions as F

from seekframe.functions import web

CASES = {
    "http://2130706433/": "loopback target",
    "http://0x7f000001/": "loopback target",
    "http://0x7F.1/": "loopback target",
    "http://127.1/": "loopback target",
    "http://0177.0.0.1/": "loopback target",
    "http://[::ffff:127.0.0.1]/": "loopback target",
    "http://[::ffff:7f00:1]/": "loopback target",
    "http://[0:0:0:0:0:ffff:7f00:1]:80/": "loopback target",
    "http://[0:0:0:0:0:0:0:1]/": "loopback target",
    "http://[64:ff9b::10.0.0.1]/": "private network target",
    "http://[2002:a00:1::]/": "private network target",
    "http://localhost./": "loopback target",
    "http://LOCALHOST:8080/": "loopback target",
    "http://user:pw@127.0.0.1/": "loopback target",
    "http://ex.com@127.0.0.1/": "loopback target",
    "http://a@b@10.0.0.1/": "private network target",
    "http://0/": "unspecified address",
    "http://[::]/": "unspecified address",
    "http://0.1/": "0.0.0.0/8",
    "http://169.254.169.254/latest": "link-local target",
    "http://2852039166/": "link-local target",
    "http://[fe80::1]/": "link-local target",
    "http://[fd00::1]/": "unique local address",
    "http://100.64.0.1/": "carrier-grade NAT range",
    "http://224.0.0.1/": "multicast target",
    "http://255.255.255.255/": "reserved address",
    "http://999.1.1.1/": "malformed url",
    "http://99999999999999999999/": "malformed url",
    "http://1.2.3.4.5/": "malformed url",
    "http://10.0.0.1\\@ex.com/": "malformed url",
    "http://e x.com/": "malformed url",
    "ftp://ex.com/": "only http(s) targets are crawled",
    "http:///x": "url has no host",
    "http://8.8.8.8/": None,
    "http://134744072/": None,
    "http://172.32.0.1/": None,
    "http://[2606:4700::1111]/": None,
    "https://ex.com/127.0.0.1?u=http://localhost/": None,
    "http://10.example.com/": None,
    "http://0x7f.example.com/": None,
}


def test_every_notation_of_an_address(spark):
    rows = spark.createDataFrame([(u,) for u in CASES], "url string").select("url", web.target_reason(F.col("url")).alias("why")).collect()
    assert {r.url: r.why for r in rows} == CASES


def test_dotted_addresses_against_the_standard_library(spark):
    hosts = [f"{a}.{b}.{c}.9" for a in (1, 9, 10, 11, 100, 127, 128, 169, 172, 192, 198, 223, 224, 239, 255, 0) for b in (0, 15, 16, 31, 32, 63, 64, 127, 168, 254) for c in (0, 7)]
    rows = spark.createDataFrame([(f"http://{h}/",) for h in hosts], "url string").select("url", web.target_reason(F.col("url")).isNull().alias("fine")).collect()
    for r in rows:
        ip = ipaddress.ip_address(r.url[7:-1])
        private = ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or any(ip in ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "100.64.0.0/10", "0.0.0.0/8"))
        assert r.fine != private, r


def test_names_of_dropped_elements_end(spark):
    html = "<scripture>kept</scripture><script>gone</script><style type=x>gone</style><svgx>kept</svgx>"
    got = spark.createDataFrame([(html,)], "h string").select(web.stripped_page(F.col("h"))).first()[0]
    assert got.count("kept") == 2 and "gone" not in got


def test_crawl_delays(spark):
    text = "User-agent: bad\nCrawl-delay: 9\nUser-agent: *\n# Crawl-delay: 7\nCrawl-delay: 2.5\nCrawl-delay: soon\n"
    files = spark.createDataFrame([("a", text), ("b", "User-agent: *\nDisallow: /"), ("c", None), ("d", "User-agent: *\nCrawl-delay: -3")], "host string, robots_txt string")
    assert {r.host: r.delay for r in web.crawl_delays(files, "seekframe").collect()} == {"a": 2.5, "b": 0.0, "c": 0.0, "d": 0.0}
