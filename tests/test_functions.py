"""Row-level expectations of the column functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.functions import grounding as G
from storyloom.functions import pages as P
from storyloom.functions import scores as S
from storyloom.functions import text as X
from storyloom.functions import urls as U
from storyloom.operators import retrieval, scoring, watch


def test_normalize_url(apply):
    cases = {
        "https://www.Example.com/a/b/?utm_source=x&b=2&a=1#frag": "https://example.com/a/b?a=1&b=2",
        "HTTP://example.com:80/": "http://example.com/",
        "https://example.com:443/x": "https://example.com/x",
        "https://example.com": "https://example.com/",
        "https://e.com/p?ref=1&fbclid=2&q=a+b": "https://e.com/p?q=a+b",
        "https://e.com/p?flag&b=~x*": "https://e.com/p?b=~x%2A&flag=",
        "relative/path ": "relative/path",
        "   ": None,
        "": None,
        None: None,
        "//e.com/x/": "http://e.com/x",
        "https://e.com/a?q=%D0%BF": "https://e.com/a?q=%D0%BF",
    }
    got = apply(U.normalize_url, list(cases))
    assert got == list(cases.values())
    assert apply(U.normalize_url, got) == got  # idempotent


def test_hosts_and_shapes(apply):
    skip = lambda c: U.host_matches(c, K.SKIP_HOSTS)
    assert apply(skip, ["https://x.com/a", "https://phoronix.com/x.com", "https://m.twitter.com/a", None]) == [True, False, True, False]
    assert apply(U.readable_host_url, ["https://www.reddit.com/r/a", "https://old.reddit.com/r/a", "https://e.com"]) == [
        "https://old.reddit.com/r/a", "https://old.reddit.com/r/a", "https://e.com",
    ]
    assert apply(U.tweet_parts, ["https://x.com/bob/status/12?s=1", "https://x.com/bob"])[0].asDict() == {"user": "bob", "status": "12"}
    repos = apply(U.repo_parts, ["https://github.com/o/r.git", "https://github.com/topics/rust", "https://www.github.com/o/r/tree/main#x", "https://e.com/o/r"])
    assert [r and (r.owner, r.repo) for r in repos] == [("o", "r"), None, ("o", "r"), None]


def test_title_from_url(apply):
    got = apply(U.title_from_url, ["https://e.com/blog/my-first_post.html", "https://e.com/2024/some-story/123/", "https://e.com/", "https://github.com/o/repo", "nothing"])
    assert got == ["My first post", "Some story", None, "Repo", None]


def test_html_to_text(apply):
    assert apply(X.strip_html, ["<p>Hi&nbsp;&mdash; <b>you</b> &#x41;</p>", "<a href='x'>Comments</a>", "  ", None, "Read  More"]) == ["Hi — you A", None, None, None, None]
    assert apply(X.clean_title, ["<a>Comments</a>", " <i></i> "]) == ["Comments", None]


def test_detect_lang(apply):
    assert apply(X.detect_lang, ["привет мир", "hello world", "Rust и go abcabc", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa я", None]) == ["ru", "en", "ru" if 1 * 3 >= 13 else "en", "en", "en"]


def test_hashtags(apply):
    assert apply(X.hashtags, [(["AI agents", "3d-print", "ai-agents", "Rust!", "go", "sixth"],), (None,)], "x array<string>") == ["#ai_agents #rust #go", ""]


def test_derive_title(apply):
    long = "слово " * 30
    got = apply(
        X.derive_title,
        ["\n\n🔥 **Bold** [link](http://a.b) title http://x.y\nrest", None, "   ", "First sentence is here now. " + "x" * 200, long, "A. " + "word " * 40, "https://only.link/x"],
    )
    assert got[0] == "Bold link title"
    assert got[1] is None and got[2] is None and got[6] is None
    assert got[3] == "First sentence is here now."
    assert got[4].endswith("…") and len(got[4]) <= 91 and not got[4].endswith(" …")
    assert got[5].endswith("word…")


def test_title_chain(apply):
    rows = [("Own", "text", "f", None), (" ", "x" * 100, "f", "<think>a</think>«Model title.»"), (None, "short", "f", "Model"), (None, "https://e.com/blog/a-b", "f", None), (None, None, "@ch", None), (None, "", None, None)]
    got = apply(lambda t, x, f, m: X.title_or_fallback(t, x, f, m), rows, "t string, x string, f string, m string")
    assert got == ["Own", "Model title", "short", "A b", "Запись @ch", None]


def test_small_text_functions(apply):
    assert apply(lambda t, x: X.embed_text(t, x), [("T", "b"), (None, None), ("T", None), ("", "y" * 3000)], "t string, x string") == ["T\nb", "(empty)", "T", "y" * 2000]
    assert apply(X.slugify, ["Large Language Models!", "Нейро сети", "", "---", "a" * 80]) == ["large-language-models", "нейро-сети", "untitled", "untitled", "a" * 60]
    assert apply(X.age_label, [(5,), (60,), (7200,), (86400 * 2,), (86400 * 14,), (None,), (-5,)], "x long") == ["только что", "1м", "2ч", "2д", "2нед", "", "только что"]
    assert apply(X.source_bucket, [("rss", "tw_a"), ("telegram", "x"), (None, None)], "s string, f string") == ["twitter", "telegram", "other"]
    assert apply(X.source_label, [("tw_bob", "twitter"), ("gh_stars_x", "rss"), ("gh_repos_y", "rss"), ("gh_z", "rss"), ("@ch", "telegram"), ("hn", "rss"), (None, "rss"), (None, None)], "f string, b string") == [
        "🐦 @bob", "🐙 ★x", "🐙 y", "🐙 GitHub", "✈️ @ch", "📡 hn", "📡 rss", "📡 источник",
    ]
    assert apply(X.card_mode, ["x" * 600, "x" * 60, "x" * 59, None, " " * 700]) == ["full", "brief", "bare", "bare", "bare"]
    assert apply(X.topic_emoji, [(["python", "security"], "hn"), (["Rust"], "hn"), ([], "gh_x"), (None, "tw_x"), (["zzz"], None)], "t array<string>, f string") == ["🛡", "🦀", "📦", "💬", "📌"]


def test_markdown(apply):
    md = "# Title\n[![b](i)](l) ![x](y) <p>Hi</p>\n> quote [text](url)\n\n\n\nEnd<!-- c\nd -->"
    assert apply(X.markdown_to_text, [md]) == ["Title\nHi \nquote text\nEnd"]


def test_upgrade_and_summary(apply):
    up = lambda u, s, t, p: X.upgraded_text(u, s, t, p)
    rows = [("http://a", "rss", "ab", "abc"), ("http://a", "telegram", "ab", "abc"), (None, "rss", "ab", "abc"), ("http://a", "rss", "abc", "ab"), ("http://a", "rss", None, "p"), ("http://a", "rss", "x" * 1201, "y" * 2000)]
    assert apply(up, rows, "u string, s string, t string, p string") == ["abc", "ab", "ab", "abc", "p", "x" * 1201]
    route = apply(lambda t, x, f: X.passthrough_summary(t, x, f), [("T", "short", "hn"), (None, "short", "hn"), (None, "long " * 99, "tw_a"), (None, None, "hn")], "t string, x string, f string")
    assert [(r.use_model, r.summary) for r in route] == [(False, "short"), (True, None), (False, ("long " * 99).strip()), (False, None)]


def test_model_answers(apply):
    raw = '<think>{"x":1}</think> ok {"tags":[" AI ","", "Rust","c","d","e","f"],"vertical":" IT ","insight":1.7,"score":-2} end'
    a = apply(X.normalized_answer, [raw, "no json", '{"insight":"high","vertical":"other"}'])
    assert (a[0].tags, a[0].vertical, a[0].insight, a[0].relevance) == (["ai", "rust", "c", "d", "e"], "it", 1.0, 0.0)
    assert (a[1].tags, a[1].insight, a[1].relevance) == (None, None, None)
    assert (a[2].vertical, a[2].insight) == (None, None)
    assert apply(X.tidy_answer, ['<THINK>a\nb</THINK> "Hello" ', '""', None]) == ["Hello", None, None]


def test_meta_and_pages(apply):
    html = "<meta content='D &amp; E' name=\"og:description\"><META property=\"og:title\" content=\" T \"/>"
    assert apply(lambda h: P.meta_tag(h, "og:title"), [html, "<p>"]) == ["T", None]
    assert apply(lambda h: P.meta_tag(h, "og:description"), [html]) == ["D & E"]
    assert apply(P.page_text, [html, "<body><nav>menu</nav><article>short</article><p>" + "long " * 100 + "</p></body>", "<article>" + "w " * 300 + "</article>"]) == [
        "T\n\nD & E", "short " + ("long " * 100).strip(), ("w " * 300).strip(),
    ]


def test_watch_topics(apply):
    topics = [("Iran", ["iran", "тегеран"]), ("Нефть", ["oil", "нефт"]), ("RUB/USD", ["usd/rub"]), ("Claude", ["claude"])]
    fn = lambda t, x: watch.match_topics(t, x, topics)
    rows = [("Нефтяной рынок", None), ("turmoil", "USD/RUB course"), ("IRANIAN", "claude-3 in Тегеране"), (None, "x" * 4000 + " iran"), (None, None)]
    assert apply(fn, rows, "t string, x string") == [["Нефть"], ["RUB/USD"], ["Iran", "Claude"], [], []]


def test_scores(apply):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    ts = lambda p: S.freshness(p.cast("timestamp_ntz"), now)
    got = apply(ts, ["2024-01-08 00:00:00", None, "2024-02-01 00:00:00", "2024-01-10 00:00:00"])
    assert [round(g, 9) for g in got] == [round(math.exp(-1), 9), round(math.exp(-0.5), 9), 1.0, 1.0]
    base = lambda r, n: S.base_score(F.lit("2024-01-10").cast("timestamp_ntz"), r, n, now)
    assert [round(x, 6) for x in apply(base, [(None, 0), (0.5, 1), (0.0, 3)], "r double, n int")] == [1.0, 1.5, round(1 + math.log(3), 6)]
    ps = lambda r, n: S.personal_score(r, F.lit(1.0), F.lit(None), F.lit(None), F.lit(None), n)
    assert [round(x, 6) for x in apply(ps, [(1.0, 0), (1.0, 10), (1.0, 40), (None, 0)], "r double, n int")] == [0.5, 0.6, 0.7, 0.0]
    assert apply(S.growth, [(20.0, 10.0), (5.0, 0.0), (0.0, 0.0), (5.0, 10.0)], "c double, p double") == [1.0, 2.0, 0.0, -0.5]
    st = lambda c, p: S.strength(c, p, F.lit(0.5))
    a, b = apply(st, [(100.0, 1.0), (100.0, 25.0)], "c double, p double")
    assert a == b  # momentum is capped
    assert apply(S.direction, [(20.0, 10.0), (10.0, 10.0), (5.0, 10.0)], "c double, p double") == ["↑", "→", "↓"]
    assert [round(x, 6) for x in apply(S.cosine, [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a array<double>, b array<double>")] == [round(2**-0.5, 6), 0.0, 0.0]


def test_quiet_hours(apply):
    at = lambda q: lambda c: scoring.in_quiet_hours(c.cast("timestamp_ntz"), q)
    hours = ["2024-01-01 23:00:00", "2024-01-01 07:59:00", "2024-01-01 08:00:00"]
    assert apply(at("0-8"), hours) == [False, True, False]
    assert apply(at("22-8"), hours) == [True, True, False]
    assert apply(at("5-5"), hours) == [False] * 3 and apply(at("x"), hours) == [False] * 3


def test_search_terms(apply):
    assert apply(retrieval.search_terms, ["свежие ии чат проекты для селф хостинга", "latest the", "Rust rust async", None]) == [
        ["ии", "чат", "проекты", "селф", "хостинга"], None, ["rust", "async"], None,
    ]
    assert apply(retrieval.wants_fresh, ["latest rust", "rust"]) == [True, False]
    assert apply(retrieval.wants_projects, ["self hosted chat", "rust"]) == [True, False]


def test_grounding(spark):
    rows = [
        ("Rust 1.80 вышел", "the rust 1.80 release", []),
        ("Модель GPT-5.5 набрала 97", "GPT‑5.5 scored 95", ["97"]),
        ("Выросло на 1 290 строк", "grew by 1290 lines", []),
        ("Осталось 4 сервера", "four remained", []),
        ("Использует Kafka", "uses rabbitmq", ["kafka"]),
        ("5 раз", "in 2025", ["5"]),
        ("AI-агент и open source", "ничего", []),
        ("gpt 5.5", "GPT-5.5", []),
        ("доля 2,5", "share 2.5", []),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, claim string, source string, want array<string>")
    got = G.with_ungrounded(df, "claim", "source", "bad").orderBy("i").collect()
    assert [r.bad for r in got] == [r.want for r in got]


def test_cards(spark):
    from storyloom.operators import cards

    source = "Rust grew by 20 percent. " * 30
    rows = [
        (1, '{"line":"Rust grew 20","points":["• Rust","Go won 99","常驻 x"]}', source),
        (2, '{"line":"Zig won","points":["Rust"]}', source),
        (3, '{"line":"Rust","points":"Rust\\n- 20 percent"}', "Rust 20 percent " * 5),
    ]
    got = {r.id: r for r in cards.grounded(cards.parsed_cards(spark.createDataFrame(rows, "id long, answer string, source string"))).collect()}
    assert (got[1].mode, got[1].line, got[1].points) == ("full", "Rust grew 20", ["Rust"])
    assert got[1].dropped == ["point: 99, won", "point: чужое письмо"]
    assert (got[2].mode, got[2].line, got[2].points) == ("bare", None, [])
    assert got[2].dropped == ["line: won, zig"]
    assert (got[3].mode, got[3].points) == ("brief", ["Rust", "20 percent"])
