from kohorta.llm import line_dedup as L


def pages(spark):
    rows = [(i, f"https://u@H.com:80/p{i}?q", f"<nav>Menu</nav><p>Body {i}<br>twice<br>twice</p><!-- x\ny -->") for i in range(10)]
    rows += [(20, "https://other.com/", "<p>Menu</p>"), (21, None, "<p>Menu</p>"), (22, "nonsense", "Menu"),
             (23, "http://h.com/", None), (24, "http://h.com", ""), (3, rows[3][1], rows[3][2])]
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, host int, __drop int")


def test_frequent_lines_go(spark):
    got = {r.page_id: r for r in L.drop_site_lines(pages(spark)).collect()}
    assert (got[4].host, got[4].n_lines, got[4].n_dropped, got[4].kept_text) == ("h.com", 4, 3, "Body 4")
    assert got[3].kept_text == "Body 3"
    for k in (20, 21, 22):
        assert (got[k].n_dropped, got[k].kept_text) == (0, "Menu")
    assert [(got[k].n_lines, got[k].kept_text) for k in (23, 24)] == [(0, ""), (0, "")]


def test_rows_and_columns_stay(spark):
    out = L.drop_site_lines(pages(spark))
    assert out.count() == 16 and out.columns == ["page_id", "url", "html", "__drop", "host", "n_lines", "n_dropped", "kept_text"]
    assert L.drop_site_lines(pages(spark).limit(0)).count() == 0


def test_plain_text_and_long_text(spark):
    long = "\n".join(f"line {i}" for i in range(50_000))
    docs = spark.createDataFrame([("http://a/", long + "\nfoot")] + [("http://a/", f"{i}\nfoot") for i in range(3)], "u string, t string")
    out = L.drop_site_lines(docs, url="u", text="t", lines=L.plain_lines).collect()
    assert sorted(r.n_dropped for r in out) == [1, 1, 1, 1] and max(r.n_lines for r in out) == 50_001


def test_no_python_in_the_plan(spark, small):
    from kohorta.llm import decontaminate, mixing

    for query in (L.query, mixing.query, decontaminate.query):
        plan = query(spark, small)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
