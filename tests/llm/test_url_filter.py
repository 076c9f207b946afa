from itinera.llm.url_filter import judge_urls, propagate

SCHEMA = "page_id long, url string, html string, rule string, host string"


def test_rules_hosts_and_paths(spark):
    cases = [
        ("http://a.net/x", "a.net", "/x", "net/", "block"),
        ("http://a.net", "a.net", "", None, "block"),
        ("https://M.Example.NET/en/7?x#y", "m.example.net", "/en/7", "example.net/en/", "allow"),
        ("https://example.com/de/1", "example.com", "/de/1", "example.com/de/", "block"),
        ("https://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"),
        ("http://b.org/fr/?q", "b.org", "/fr/", "org/fr/", "allow"),
        ("mailto:x@y.net", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("x://h#/net/", "h", "", None, "allow"),
        ("http://a.net\n/x", "a.net\n", "/x", None, "allow"),
    ]
    rows = [(i, c[0], None, "r", "h") for i, c in enumerate(cases)] + [(0, cases[0][0], None, "r", "h")]
    got = judge_urls(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == cases[r.page_id][1:]


def test_distrust_flows_back_over_links(spark):
    rows = [(0, "http://bad.net/a", None, "", ""), (1, "http://ally.io/a", '<a href="http://bad.net/z">', "", "")]
    rows += [(2, "http://fine.io/a", '<a href="/local"><a href="//good.org/q">', "", ""), (3, "http://good.org/fr/1", "", "", "")]
    got = {r.page_id: r.verdict for r in judge_urls(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: "block", 1: "block", 2: "allow", 3: "allow"}


def test_propagation_equals_power_iteration(spark):
    edges = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d")]
    seeds = [("a", "trust", 1.0), ("d", "distrust", 1.0)]
    got = propagate(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(seeds, "host string, side string, weight double"), 0.5, 5)
    want = {}
    for side, arcs, seed in (("trust", edges, "a"), ("distrust", [(b, a) for a, b in edges], "d")):
        score = {seed: 1.0}
        for _ in range(5):
            new = {}
            for s, t in arcs:
                new[t] = new.get(t, 0) + 0.5 * score.get(s, 0) / sum(x[0] == s for x in arcs)
            new[seed] = new.get(seed, 0) + 1 - sum(new.values())  # hosts without links pass on to the seeds
            score = new
        want |= {(h, side): round(v, 9) for h, v in score.items() if v}
    assert {(r.host, r.side): round(r.score, 9) for r in got.collect() if r.score} == want


def test_empty_table(spark):
    assert judge_urls(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_chains_and_loops_settle(spark):
    """Against a dense power iteration run to its end; distrust goes up a chain as far as the threshold."""
    names = ["bad.net"] + [f"h{i}.io" for i in range(12)]
    links = [(b, a) for a, b in zip(names, names[1:])] + [("p.io", "q.io"), ("q.io", "p.io"), ("q.io", "bad.net")]
    hosts = sorted({h for e in links for h in e})
    html = {h: " ".join(f'<a href="//{b}/">' for a, b in links if a == h) for h in hosts}
    rows = [(i, f"http://{h}/a", html[h], "", "") for i, h in enumerate(hosts)]
    got = {r.host: r for r in judge_urls(spark.createDataFrame(rows, SCHEMA)).collect()}
    into = {h: [a for a, b in links if b == h] for h in hosts}
    score = {h: float(h == "bad.net") for h in hosts}
    for _ in range(400):
        new = dict.fromkeys(hosts, 0.0)
        for h in hosts:
            for a in into[h]:
                new[a] += 0.85 * score[h] / len(into[h])
        new["bad.net"] += 1 - sum(new.values())
        score = new
    least = 0.25 / len(hosts)
    assert all(abs(got[h].distrust - score[h]) < 0.01 * least for h in hosts)
    assert score["h11.io"] < least < score["h6.io"]
    assert {h for h in hosts if got[h].verdict == "block"} == {h for h in hosts if score[h] > least or h == "bad.net"}


def test_hubs_and_very_long_urls(spark):
    """A host with most links, and one that most link to, against a dense power iteration."""
    edges = [("hub", f"h{i}") for i in range(1500)] + [(f"h{i}", "sink") for i in range(0, 1500, 2)] + [("sink", "hub")]
    seeds = [("hub", "trust", 2.0), ("h1", "trust", 1.0), ("sink", "distrust", 1.0)]
    got = propagate(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(seeds, "host string, side string, weight double"), rounds=12)
    scores = {(r.host, r.side): r.score for r in got.collect()}
    for side, arcs in (("trust", edges), ("distrust", [(b, a) for a, b in edges])):
        start = {h: w / sum(x[2] for x in seeds if x[1] == side) for h, s, w in seeds if s == side}
        degree, score = {}, start
        for s, _ in arcs:
            degree[s] = degree.get(s, 0) + 1
        for _ in range(12):
            new = {}
            for s, t in arcs:
                new[t] = new.get(t, 0) + 0.85 * score.get(s, 0) / degree[s]
            rest = 1 - sum(new.values())
            score = {h: new.get(h, 0) + start.get(h, 0) * rest for h in {*new, *start}}
        assert all(abs(scores.get((h, side), 0) - v) < 1e-9 for h, v in score.items())
        assert abs(sum(v for (_, s), v in scores.items() if s == side) - 1) < 1e-9
    row = judge_urls(spark.createDataFrame([(1, "http://a.net/" + "x" * 500_000, "y" * 500_000, "", "")], SCHEMA)).first()
    assert row.verdict == "block" and len(row.path) == 500_001
