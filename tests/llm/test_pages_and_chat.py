import pytest

from tidemark.llm import chat, html_extract
from tidemark.llm.html_extract import readings

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p>";</script></head><body><div id="top-nav"><a>Home</a></div>
<div class="wrap"><div class="sidebar"><h3>Related</h3><p>One two three four.</p></div><div class="post-content"><h1>Title &amp; more</h1>
<p>First   para, with words.<p>Second para <a href=x>link</a> and &lt;b&gt;.<ul><li>One<li>Two</ul><div class="share-buttons">Share</div>
<form>Sign up</form></div><section id="comments"><p>Great article, I liked it a lot, really. Yes, indeed, so very much text to read here.</p></section></div>
<footer>(c)</footer></body></html>"""
MAIN = "Title & more\nFirst para, with words.\nSecond para link and <b>.\nOne\nTwo"


def test_a_page():
    path, weight, found = readings(PAGE)
    assert path == "html/body/div.wrap/div.post-content" and 0.5 < weight <= 1 and found[0] == (path, MAIN)


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("<p>", ""), ("plain <br> text", "plain\ntext"), ("<main><p>a<p>b</main><nav>c</nav>", "a\nb"), ("<article>a<!-- x --> b<aside>c</aside></article>", "a b"), ("<p>x</p><script>y", "x"), ('<article><h2 class="section-header">a</h2><p class="ad">b<p>c</article>', "a\nc")])
def test_small_pages(page, text):
    found = readings(page)[2]
    assert (found[0][1] if found else "") == text


LONG = "Prose that goes on for a while, sentence after sentence, with commas and stops, as articles do. " * 3


@pytest.mark.parametrize(
    "inside,text",
    [
        ('<p title="5" wide">First para</p><p>second</p>', "First para\nsecond"),
        ("<p title='a>b' x=\"c>d\" y=e>one</p><p z='open>two</p>", "one\ntwo"),
        ("<p>Area is <math><mi>a</mi><mo>+</mo><mn>2</mn></math> metres.</p>", "Area is a+2 metres."),
        ("<p>See <label>the label</label> and <x-note>the note</x-note>.</p>", "See the label and the note."),
        ('<p class="discussion">a</p><p class="legal-history">b</p><p class="ad">c</p>', "a\nb"),
        (f'<div class="popular-science"><p>short</p></div><div class="related"><p>{LONG}</p></div>', f"short\n{LONG.strip()}"),
        (f'<div class="related-posts"><a href=x>{LONG}</a></div><div class="comment-list"><p>{LONG}</p></div><p>kept</p>', "kept"),
        ('<div class="article-header"><h1>Title</h1></div><div class="share-buttons">Share it</div><p>kept</p>', "Title\nkept"),
        (f'<div class="cookie-notice"><p>{LONG}</p></div><dialog><p>closed</p></dialog><p>kept</p>', "kept"),
    ],
)
def test_parts_of_an_article(inside, text):
    found = readings(f"<body><article>{inside}</article></body>")[2]
    assert found[0][1] == text


def test_against_another_parser(spark):
    """All pages of a table: the blocks within ``article``, by the parser of the standard library."""
    from html.parser import HTMLParser

    class Slow(HTMLParser):
        BLOCKS = ("p", "h1", "h2", "h3", "li", "ul", "div", "br", "article", "section", "blockquote")

        def __init__(self):
            super().__init__()
            self.inside, self.found, self.now = 0, [], ""

        def end(self):
            if text := " ".join(self.now.split()):
                self.found.append(text)
            self.now = ""

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            if tag in self.BLOCKS:
                self.end()

        def handle_endtag(self, tag):
            if tag in self.BLOCKS:
                self.end()
            self.inside -= tag == "article"

        def handle_data(self, data):
            if self.inside:
                self.now += data

    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = {r["page_id"]: r for r in html_extract.extract(df).collect()}
    for p in df.collect():
        slow = Slow()
        slow.feed(p["html"])
        slow.close()
        assert rows[p["page_id"]]["text"] == "\n".join(slow.found) and rows[p["page_id"]]["n_chars"] == len("\n".join(slow.found))


def test_a_long_page_and_columns_of_inner_names(spark):
    from pyspark.sql import functions as F

    page = f"<article>{'<p>word after word</p>' * 50_000}</article>"
    df = spark.createDataFrame([(1, "http://a.example/1", page), (1, "http://a.example/1", page)], "page_id long, url string, html string")
    df = df.withColumns({n: F.lit(7) for n in ("host", "first", "weight", "paths", "places", "texts", "path", "votes", "text", "n_chars")})
    found = html_extract.extract(df).collect()
    assert len(found) == 2 and all(r["n_chars"] == 50_000 * 16 - 1 for r in found)


def test_hosts_vote(spark):
    """A page whose own best container is its long list of teasers is read by its host's path."""
    article = '<body><div class="list"><p>{}</p></div><div class="body"><p>{}</p></div></body>'
    many = [(i, f"http://a.example/{i}", article.format("short", "An article of many words, with commas, and stops. " * 5)) for i in range(9)]
    odd = [(100, "http://a.example/x", article.format("Some words of a list, which go on. " * 6, "An article, a little shorter, of words. " * 4)), (101, None, None), (102, "nonsense", ""), (102, "nonsense", ""), (103, "http://b.example", PAGE)]
    df = spark.createDataFrame(many + odd, "page_id long, url string, html string")
    found = {r["page_id"]: r for r in html_extract.extract(df).collect()}
    assert found[100]["text"].startswith("An article, a little shorter") and found[101]["text"] == found[102]["text"] == ""
    assert found[103]["text"] == MAIN and found[103]["n_chars"] == len(MAIN)
    assert html_extract.extract(df).count() == len(many) + len(odd) and html_extract.extract(df.limit(0)).count() == 0


def test_an_article_over_siblings():
    """Containers of one path are one text in page order, whichever is the largest, without what lies between."""
    first, second = "An article of many words, with commas, and stops. " * 6, "Its second part, a little shorter, goes on here. " * 4
    for a, b in ((first, second), (second, first)):
        found = readings(f'<body><div class="wrap"><div class="text"><p>{a}</p></div><div class="ad"><p>Buy now.</p></div><div class="text"><p>{b}</p></div></div></body>')[2]
        assert found[0] == ("html/body/div.wrap/div.text", f"{a.strip()}\n{b.strip()}")


def test_deep_pages_and_host_pages(spark, sf):
    assert readings("<div>" * 3000 + "deep")[2][0][1] == "deep"
    df = spark.read.parquet(f"{sf}/pages.parquet")
    rows = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    for p in df.collect():
        assert "©" not in rows[p["page_id"]] and "track(" not in rows[p["page_id"]] and "Home" not in rows[p["page_id"]]


@pytest.fixture(scope="module")
def model(spark):
    turns = [(c, t, ("user", "assistant")[t % 2], "Could you tell me?" if t % 2 == 0 else "Yes, here it is.") for c in range(40) for t in range(6)]
    return chat.learn(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))


@pytest.mark.parametrize(
    "text,turns",
    [
        ("User: hi\nthere\nAssistant: hello", [("user", "hi\nthere"), ("assistant", "hello")]),
        ("### System:\nBe kind\n### Human:\nwhat?\n### Response:\nthis", [("system", "Be kind"), ("user", "what?"), ("assistant", "this")]),
        ("<|im_start|>user\na\n\nb<|im_end|>\n<|im_start|>assistant\nc<|im_end|>", [("user", "a\n\nb"), ("assistant", "c")]),
        ("**Q**: one?\n**A**: two", [("user", "one?"), ("assistant", "two")]),
        ("Alice: how are you?\nBob: fine.\nAlice: sure?\nBob: yes.", [("user", "how are you?"), ("assistant", "fine."), ("user", "sure?"), ("assistant", "yes.")]),
        ("Can you help?\n\nSure.\n\nWith this?", [("user", "Can you help?"), ("assistant", "Sure."), ("user", "With this?")]),
        ("user: hi\nassistant: ok\nwarning: foo bar\nuser: thanks", [("user", "hi"), ("assistant", "ok\nwarning: foo bar"), ("user", "thanks")]),
        ("Human: one\nHuman: two\nAI: three", [("user", "one\ntwo"), ("assistant", "three")]),
        ("User: first\n\nsecond\n\nAssistant: third", [("user", "first\n\nsecond"), ("assistant", "third")]),
        ("### User:\na\n\n### Assistant:\nb\n\nc?\n\n### Assistant:\nd", [("user", "a"), ("assistant", "b"), ("user", "c?"), ("assistant", "d")]),
        (None, []), ("", []), (" \n\n", []),
    ],
)
def test_transcripts(model, text, turns):
    assert chat.parse(text, model) == turns


def test_any_number_of_speakers_and_turns(model):
    names = ("Alice", "Bob", "Cara", "Dan", "Eve", "Finn")
    said = "\n".join(f"{n}: line {i} of {n}" for i in range(20) for n in names)
    found = chat.read(said, model)
    assert [name for _, name, _ in found] == [n.lower() for _ in range(20) for n in names]
    assert [text for _, _, text in found] == [f"line {i} of {n}" for i in range(20) for n in names]
    turns = [(("user", "assistant")[i % 2], f"turn {i}") for i in range(200)]
    assert chat.parse("\n".join(f"{r}: {t}" for r, t in turns), model) == turns


def test_roles_are_recovered_by_what_was_learnt(spark):
    """Of conversations that taught nothing, nearly all come back whole; an untrained model can't."""
    turns = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")
    truth: dict = {}
    for r in turns.orderBy("conv_id", "turn").collect():
        truth.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    held_out = {r["conv_id"]: r["transcript"] for r in chat.transcripts(turns).collect() if r["conv_id"] % 5 == 0}
    share = lambda m: sum(chat.parse(t, m) == truth[k] for k, t in held_out.items()) / len(held_out)
    assert len(held_out) > 150
    assert share(chat.learn(turns.filter("conv_id % 5 <> 0"))) > 0.93 and share(chat.Model({}, {}, {})) < 0.5


def test_odd_turns(spark, model):
    """Null texts, roles, numbers and keys, repeated turns and columns of inner names."""
    from pyspark.sql import functions as F

    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", None), (1, 2, None, "b"), (2, None, "user", ""), (None, 0, "user", "c"), (3, 0, "tool", "word " * 20000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({n: F.lit(1) for n in ("style", "l", "ls", "line", "bare", "was", "next", "transcript")})
    assert chat.learn(df).step["user"] and chat.learn(df.limit(0)).step["user"]
    found = {r["conv_id"]: r["n_turns"] for r in chat.format_transcripts(chat.transcripts(df), model).collect()}
    assert found.keys() == {1, 2, 3, None} and found[2] == 0 and found[3] == found[None] == 1


def test_odd_transcripts(spark, model):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "User: x"), (3, "User: " + "word " * 20000), (3, "User: y")], "conv_id long, transcript string")
    assert sorted(r["n_turns"] for r in chat.format_transcripts(df, model).collect()) == [0, 0, 1, 1, 1]
    assert chat.format_transcripts(df.limit(0), model).count() == 0
