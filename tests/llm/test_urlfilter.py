from judgeloom.llm import urlfilter

CASES = [
    (None, "", "", None),
    ("no scheme", "", "", None),
    ("http://A.Example.ORG/es/1", "a.example.org", "/es/1", "example.org/es/"),
    ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/"),
    ("http://badexample.org/es/", "badexample.org", "/es/", "org/"),
    ("http://x.com/fr/?q=/de/", "x.com", "/fr/", "com/fr/"),
    ("http://x.com/de/#a", "x.com", "/de/", "com/de/"),
    ("http://x.org?a=/es/", "x.org", "", None),
    ("http://x.org:80/", "x.org:80", "/", None),
    ("a://b://c.org/", "b:", "//c.org/", None),
    ("http://x.com/FR/", "x.com", "/FR/", None),
    ("http://x.net/" + "y" * 5000, "x.net", "/" + "y" * 5000, None),
]


def test_hosts_paths_rules(spark):
    pages = spark.createDataFrame([(i, c[0], "clash") for i, c in enumerate(CASES)] + [(2, CASES[2][0], "clash")], "page_id long, url string, host string")
    got = urlfilter.judge(pages).collect()
    assert len(got) == len(CASES) + 1
    for r in got:
        assert (r["host"], r["path"], r["rule"]) == CASES[r["page_id"]][1:]
        if r["rule"]:
            assert r["verdict"] == {"example.org/es/": "block", "example.org/en/1": "block", "org/": "allow", "com/fr/": "allow", "com/de/": "block"}[r["rule"]]
    assert got[0]["verdict"] == "allow" and urlfilter.judge(pages.limit(0)).count() == 0


def test_accuracy_on_urls_left_out():
    """Ten folds of the labelled table: each url is judged by a model that hasn't seen it."""
    import numpy as np

    right = {0: [], 1: []}
    for fold in range(10):
        held = [u for k, u in enumerate(urlfilter.LABELLED) if k % 10 == fold]
        weights, bias = urlfilter.train([u for k, u in enumerate(urlfilter.LABELLED) if k % 10 != fold])
        for url, blocked in held:
            ids = urlfilter.grams(*urlfilter._split(url))
            right[blocked].append((weights[ids].sum() / np.sqrt(len(ids)) + bias >= 0) == bool(blocked))
    assert np.mean(right[0]) >= 0.75 and np.mean(right[1]) >= 0.7  # 0.80 and 0.73 when written: most words of a url left out are in no other


def test_model_on_unseen_urls(spark):
    bad = ["http://casino-palace.test/play", "http://porn-videos.test/x", "http://best-pills.test/shop", "http://sports-betting.test/", "http://adserver-pixel.test/"]
    good = ["http://gazette.test/world/news", "http://www.physics-school.test/lectures", "http://harbour-museum.test/tickets/today", "http://valley-library.test/catalogue/3", "http://www.therti.test/3"]
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(spark.createDataFrame(list(enumerate(bad + good)), "page_id long, url string")).collect()}
    assert [got[i] for i in range(10)] == ["block"] * 5 + ["allow"] * 5


def test_training_by_a_plain_loop():
    """Gradient descent written out, url by url and bucket by bucket."""
    import math

    few = urlfilter.LABELLED[:4] + urlfilter.LABELLED[-4:]
    x = []
    for url, _ in few:
        ids = urlfilter.grams(*urlfilter._split(url))
        row = {}
        for i in ids:
            row[i] = row.get(i, 0) + 1 / math.sqrt(len(ids))
        x.append(row)
    w, b = {}, -1.0
    for _ in range(20):
        errors = [1 / (1 + math.exp(-(sum(w.get(i, 0.0) * v for i, v in row.items()) + b))) - y for row, (_, y) in zip(x, few, strict=True)]
        slope = {}
        for row, e in zip(x, errors, strict=True):
            for i, v in row.items():
                slope[i] = slope.get(i, 0.0) + v * e / len(few)
        w = {i: w.get(i, 0.0) - 4.0 * (g + 5e-4 * w.get(i, 0.0)) for i, g in slope.items()}
        b -= 0.4 * sum(errors) / len(errors)
    weights, bias = urlfilter.train(few, 20)
    assert abs(bias - b) < 1e-9 and all(abs(weights[i] - v) < 1e-5 for i, v in w.items())


def test_no_pages(spark):
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []
