from collections import Counter

from graphloom.llm import linefreq


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, _line string")


def page(*lines):
    return "<body><script>var x = '<p>';</script>" + "".join(f"<p>{x}</p>" for x in lines) + "<!-- <p>no</p> --></body>"


def test_lines(spark):
    df = spark.createDataFrame([("<div> a <b>b</b></div>c<br/>d<style>p{}</style>\n\n e",), (None,), ("",)], "html string")
    assert [r[0] for r in df.select(linefreq.lines_of(df["html"])).collect()] == [["a b", "c", "d", "e"], [], []]


def test_against_brute_force(spark):
    rows = []
    for i in range(60):
        host = "http://hot.example/" if i % 3 else f"https://H{i % 5}.example:80/x"
        lines = ["menu", f"own {i}", f"own {i}"] + (["rare"] if i % 20 == 0 else []) + (["half"] if i % 2 else [])
        rows.append((i, f"{host}{i}", page(*lines), "q", "q"))
    rows += [(100, None, None, "q", "q"), (101, "nohost", "", "q", "q"), (None, "http://hot.example/n", page("menu"), "q", "q"), (1, rows[1][1], rows[1][2], "q", "q")]
    rows += [(200, "http://hot.example/long", page(*[f"line {i % 20_000}" for i in range(40_000)], "menu"), "q", "q")]  # a very long page
    out = linefreq.drop_site_boilerplate(pages(spark, rows), ratio=0.2, least_pages=3).collect()
    host = lambda u: (u or "").split("://")[-1].split("/")[0].lower() if "://" in (u or "") else ""
    lines = lambda h: [x.split("</p>")[0] for x in (h or "").replace("'<p>'", "").replace("<!-- <p>no</p> -->", "").split("<p>")[1:]]
    n = Counter(host(u) for _, u, *_ in rows)
    has = Counter((host(u), x) for _, u, h, *_ in rows for x in set(lines(h)))
    want = Counter()
    for i, u, h, *_ in rows:
        kept = [x for x in lines(h) if not (has[host(u), x] >= 3 and has[host(u), x] > 0.2 * n[host(u)])]
        want[i, host(u), len(lines(h)), len(lines(h)) - len(kept), "\n".join(kept)] += 1
    assert Counter(map(tuple, out)) == want and any(r["n_dropped"] for r in out)


def test_empty(spark):
    assert linefreq.drop_site_boilerplate(pages(spark, [])).count() == 0
