"""Pages with several canonical links and redirects."""

from kredenz.llm.queries import URL_RULES
from kredenz.llm.url_filter import judge_urls


def test_a_block_reaches_all_links_of_a_page(spark):
    link, meta = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    several = link.format("http://a.info/1") + link.format("http://a.info/2") + meta.format("http://a.info/3") + "<link rel=canonical>" + meta.format("/4?x=1&amp;y=2")
    pages = [(k, f"http://a.info/{k}", None) for k in (1, 2, 3, 5)]
    pages += [(4, "http://example.com/4?x=1&y=2", None), (9, "http://example.com/de/p", several)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in judge_urls(table, URL_RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 9: "block"}


def test_sql_follows_all_links_too(spark, tmp_path):
    import random

    from check_oracle import compare, tables

    dice = random.Random(12)
    names = [f"{p}{h}.{d}" for h in ("a", "b", "c") for d in ("net", "org", "com", "example.net") for p in ("", "www.", "m.")]

    def link():
        to = dice.choice([f"https://{dice.choice(names)}/fr/{dice.randrange(4)}", f"//{dice.choice(names)}/de/", "/en/x.html", "y?utm_a=1&amp;q=2", ""])
        return dice.choice([f"<LINK href='{to}' rel=canonical>", f'<link rel="canonical" href="{to}" />', f'<meta http-equiv="refresh" content="0; URL={to}">', f"<link rel=icon href={to}>", "<link rel=canonical"])

    rows = [(k, f"http://{dice.choice(names)}/{dice.choice(['', 'fr/1', 'de/', 'en/x.html'])}", "".join(link() for _ in range(dice.randint(0, 3)))) for k in range(150)]
    rows += [(200, None, "<link rel=canonical href=http://a.net/>"), (201, "no address", "<link rel=canonical href=/x>"), (202, "http://a.com", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/made")
    (part,) = tmp_path.glob("made/*.parquet")
    part.rename(tmp_path / "pages.parquet")
    assert not compare(spark, tables(str(tmp_path)), str(tmp_path), "op10_url_filter")


def test_tags_that_are_never_closed_take_no_longer(spark):
    from kredenz.llm.queries import URL_RULES
    from kredenz.llm.url_filter import judge_urls

    page = spark.range(1).selectExpr("id AS page_id", "'http://a.com/' AS url", "repeat('<link <meta ', 300000) AS html")
    assert judge_urls(page, URL_RULES).first().verdict == "allow"
