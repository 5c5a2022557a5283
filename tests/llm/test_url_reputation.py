from tallyloom.llm import url_reputation

LABELS = "doc_id long, quality int, toxic int, host string"


def judged(spark, pages, labels=(), **options):
    p = spark.createDataFrame(pages, "page_id long, url string, verdict string")
    return sorted((tuple(r) for r in url_reputation.judge(p, spark.createDataFrame(list(labels), LABELS), **options).collect()), key=str)


def test_hosts_paths_and_rules(spark):
    urls = ["http://A.Example.ORG/en/1?x", "https://org", "https://org/", "ftp://x.example.org/es/a#b", "a://b.com/fr/de/?/de/", "http://b.com/de/", "no scheme /de/", None, "http://É.com?x://y/z", "://com/de/x", "http://xcom/de/", "http://a\n.com/de/\n?q"]
    got = {r[0]: r[1:] for r in judged(spark, [(k, u, "block") for k, u in enumerate(urls)])}
    assert got == {
        0: ("a.example.org", "/en/1", "example.org/en/1", "block"),
        1: ("org", "", None, "allow"),
        2: ("org", "/", "org/", "allow"),
        3: ("x.example.org", "/es/a", "example.org/es/", "block"),
        4: ("b.com", "/fr/de/", "com/fr/", "allow"),
        5: ("b.com", "/de/", "com/de/", "block"),
        6: ("", "", None, "allow"),
        7: ("", "", None, "allow"),
        8: ("É.com", "", None, "allow"),
        9: ("com", "/de/x", "com/de/", "block"),
        10: ("xcom", "/de/", None, "allow"),
        11: ("a\n.com", "/de/\n", "com/de/", "block"),
    }


def test_bad_hosts_are_blocked_and_priors_hold_back_small_ones(spark):
    pages = [(k, f"http://bad.site.net/x/{k}", None) for k in range(60)] + [(100 + k, f"http://good{k % 5}.fine.net/x/{100 + k}", None) for k in range(300)]
    pages += [(900, "http://one.fine.net/x/900", None), (None, "http://bad.site.net/none", None), (1, "http://bad.site.net/x/1", None)]
    labels = [(k, 0, 0, "h") for k in range(60)] + [(100 + k, 1, 0, "h") for k in range(300)] + [(900, 1, 1, "h"), (900, None, None, "h"), (None, 0, 1, "h"), (101, None, None, "h")]
    got = judged(spark, pages, labels)
    assert len(got) == len(pages)
    verdicts = {(r[1], r[4]) for r in got}
    assert ("bad.site.net", "block") in verdicts and ("bad.site.net", "allow") not in verdicts
    assert ("one.fine.net", "allow") in verdicts and all(v == "allow" for h, v in verdicts if h != "bad.site.net")


def test_many_blocked_hosts_are_joined_by_host(spark, monkeypatch):
    from tallyloom.llm import hot

    pages = [(k, f"http://{'bad' if k % 2 else 'good'}{k % 6}.a{k % 6}.net/x/{k}", None) for k in range(600)] + [(1000 + k, "http://bad1.a1.net/no-number", None) for k in range(50)]
    labels = [(k, 1 - k % 2, 0, "h") for k in range(600)]
    wanted = judged(spark, pages, labels)
    assert {(r[1], r[4]) for r in wanted} == {(f"{'bad' if k % 2 else 'good'}{k}.a{k}.net", "block" if k % 2 else "allow") for k in range(6)}
    monkeypatch.setattr(url_reputation, "BROADCAST_HOSTS", 0)
    monkeypatch.setattr(hot, "SLICE_ROWS", 30)
    assert judged(spark, pages, labels) == wanted


def test_long_urls(spark):
    long = "http://A.com/" + "x" * 200_000 + "/7?" + "y" * 200_000
    assert judged(spark, [(1, long, None)]) == [(1, "a.com", "/" + "x" * 200_000 + "/7", None, "allow")]


def test_empty_tables(spark):
    assert judged(spark, []) == []
    assert judged(spark, [(1, "http://a.net/x/5", None)]) == [(1, "a.net", "/x/5", None, "allow")]


def test_suffixes(spark):
    df = spark.createDataFrame([("a.b.co.uk",), ("b.net",), ("10.0.0.1",), ("com",), ("u@x.y.org:80",)], "host string")
    d, s = url_reputation.domain_and_suffix(df.host)
    assert [tuple(r) for r in df.select(d, s).collect()] == [("b.co.uk", "co.uk"), ("b.net", "net"), ("10.0.0.1", "10.0.0.1"), ("com", "com"), ("y.org", "org")]
