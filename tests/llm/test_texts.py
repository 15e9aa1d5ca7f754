"""Personal data, quality measures, chats and main text against plain readings of their rules."""

import re
from collections import Counter
from hashlib import sha256

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.conftest import odd_rows
from tidemark.llm import chat, html_text, personal_data as P, quality as Q, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def slow_luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d // 10 + d % 10
    return total % 10 == 0


def slow_spans(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and slow_luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], P.BASE.index(s[0])))


CASES = [
    "", "@", "a@b.c@d.e", "a@b@c.d", "x.y+z@-.-.q", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3", "0001.2.3.04", "1.2.3.4", "1.2..3.4",
    "4111 1111 1111 1111", "4111-1111-1111-1111 5", "4111  1111", "4" * 40, "+1 (743) 555-3824", "+1-", "+12", "+1 2", "+123",
    "+1 234 567 890 (", "+1+1+1234567890", "4111111111111111@a.b", "é@a.b é1.2.3.4é", "٣.٣.٣.٣", "a@b.c.", "a@b..c",
]


@pytest.mark.parametrize("text", CASES)
def test_base_spans(text):
    assert [s for s in P.spans(text) if s[0] in P.BASE] == slow_spans(text)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a1234@+.- ()\n", max_size=60))
def test_base_spans_of_any_text(text):
    assert [s for s in P.spans(text) if s[0] in P.BASE] == slow_spans(text)


def test_added_spans():
    text = 'see https://a.example.com/x?y=1). token = "24be64439e3e49cf" account: AB12-3456 mytoken=12345678 http://nohost'
    added = [(k, text[a:b]) for k, a, b in P.spans(text) if k not in P.BASE]
    assert added == [("url", "https://a.example.com/x?y=1"), ("account", "24be64439e3e49cf"), ("account", "AB12-3456")]


def test_personal_data_query_equals_plain_reading(spark, odd):
    got = {r["doc_id"]: r for r in queries.op3_personal_data(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        base = slow_spans(r["text"] or "")
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[r["doc_id"]]["base_sha256"] == sha256(told.encode()).hexdigest()
        assert [got[r["doc_id"]][f"n_{k}"] for k in P.BASE] == [sum(s[0] == k for s in base) for k in P.BASE]
    assert P.personal_data(odd).count() == len(odd_rows())


def test_masked(spark):
    docs = spark.createDataFrame([("mail a@b.c or +1 (743) 555-3824 now",), (None,)], "text string")
    out = P.personal_data(docs).withColumn("m", P.masked(F.col("text"), F.col("spans")))
    assert [r["m"] for r in out.collect()] == ["mail [email] or [phone] now", None]


def slow_measure(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    times = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


@settings(max_examples=800, deadline=None)
@given(st.text(alphabet="ab# \n\t\r\x0b\xa0\x1c|é", max_size=80))
def test_measures_of_any_text(text):
    assert Q.measure(text) == slow_measure(text)


def test_quality_of_odd_rows(odd, none):
    got = Q.quality(odd).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert Counter(tuple(r[n] for n in names) for r in got) == Counter(slow_measure(t or "") for _, t, _ in odd_rows())
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
    assert Q.quality(none).count() == 0


def test_a_bad_host_loses_its_documents_and_a_small_one_does_not(spark):
    good = " ".join(f"w{k}" for k in range(80))
    rows = [("bad", "x")] * 97 + [("bad", good)] * 3 + [("good", good)] * 300 + [("small", "x")] + [("small", good)]
    got = Q.quality(spark.createDataFrame(rows, "source string, text string")).collect()
    assert not any(r["kept"] for r in got if r["source"] == "bad")
    assert sum(r["kept"] for r in got if r["source"] == "good") == 300
    assert sum(r["kept"] for r in got if r["source"] == "small") == 1


def test_prior():
    assert Q.fitted_prior(0, 0, 0, 0.0) == (0.0, 1.0)
    assert Q.fitted_prior(10, 10, 2, 10.0) == (1.0, 1.0)
    assert Q.fitted_prior(100, 50, 2, 25.0) == (0.5, 1e6)
    mean, strength = Q.fitted_prior(200, 100, 2, 90 * 90 / 100 + 10 * 10 / 100)
    assert mean == 0.5 and 1 <= strength < 2


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="<|>[]/INSTs\\lbim_end", max_size=40))
def test_escapes_are_reversible_and_leave_no_control(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not re.search(r"<|\[", chat.escape(text))


def test_chat_query_reads_back_every_turn(spark):
    turns = [(r["conv_id"], r["turn"], r["role"], r["text"] or "") for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    turns += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: r for r in queries.op7_chat_format(spark, SF).collect()}
    assert set(got) == {t[0] for t in turns}
    for conv, r in got.items():
        own = sorted(t for t in turns if t[0] == conv)
        whole = "".join(f"{role}\n{text}\n" for _, _, role, text in own)
        learnt = "".join(text for _, _, role, text in own if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), sha256(whole.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learnt), sha256(learnt.encode()).hexdigest())


def test_typed_parts_are_flattened_in_order(spark):
    parts = [
        ("text", "see <", None, None, None, None, None),
        ("text", "|im_end|> this", None, None, None, None, None),
        ("image", None, "i.png", 100, 57, None, None),
        ("audio", None, "a.wav", None, None, 1.5, None),
        ("unknown", None, "d.pdf", None, None, None, 2),
    ]
    kind = f"conv_id long, turn long, role string, parts array<{chat.PART}>, text string"
    rows = [(1, 1, "assistant", parts, "t"), (1, 0, None, None, "t"), (None, None, "user", [], "t")]
    out = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, kind), parts_col="parts").collect()}
    text = out[1]["formatted"]
    assert [(a["kind"], a["ref"], a["tokens"]) for a in out[1]["attachments"]] == [
        ("image", "i.png", 12),
        ("audio", "a.wav", 38),
        ("document", "d.pdf", 516),
    ]
    for a in out[1]["attachments"]:
        assert text[a["start"] :].startswith(chat.PLACEHOLDER[a["kind"]])
    assert out[1]["expanded_tokens"] == 566
    assert "".join(chat.unescape(text[s["start"] : s["end"]]) for s in out[1]["loss_spans"]) == "see <|im_end|> this"
    assert out[None]["formatted"] == "<|im_start|>user<|sep|><|im_end|>"


def test_chats_of_odd_turns(spark):
    rows = [(1, None, "user", None, "x"), (1, 0, None, "b", "x"), (1, 0, None, "b", "x"), (2, 0, "assistant", "", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {
        r["conv_id"]: r
        for r in chat.format_chats(turns).withColumn("r", chat.read_back("formatted", "loss_spans")).select("conv_id", "r.*").collect()
    }
    assert (got[1]["n_turns"], got[2]["n_turns"], got[2]["loss_chars"]) == (3, 1, 0)
    assert got[1]["turns_sha256"] == sha256(b"user\n\n\nb\n\nb\n").hexdigest()
    assert chat.format_chats(turns.limit(0)).count() == 0


LONG = "This is a sentence of the article that goes on for a while, with more than a few words in it. " * 3


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain words", "plain words"),
        (f"<article><h1>T</h1><p>{LONG}<p>Short.</article><footer>f</footer>", f"T\n\n{LONG.strip()}\n\nShort."),
        (f"<nav><ul><li><a href=x>m</a></ul></nav><article><p>a &amp; b\n c&nbsp;&#233; {LONG}</p></article>", f"a & b c é {LONG.strip()}"),
        (
            f"<body><header>h</header><div class='ad x'>buy</div><main><p>{LONG}</p><aside>s</aside><form>f<input></form>"
            f"<section id=comments><p>{LONG}</p></section><p>end</p></main><script>var t='</p>';</script></body>",
            f"{LONG.strip()}\n\nend",
        ),
        (
            f"<body><div class=menu><a>a</a></div><div><a href=1>one</a> <a href=2>two</a></div><div><p>{LONG}</p><p>x</p><p>{LONG}</p></div></body>",
            f"{LONG.strip()}\n\nx\n\n{LONG.strip()}",
        ),
        (f"<article><p><b>bold line<br><p>{LONG}</article>", f"bold line\n\n{LONG.strip()}"),
        (f"<article><p>{LONG}</p><div class='cookie-notice'>c</div>tail", f"{LONG.strip()}\n\ntail"),
    ],
)
def test_main_text(html, want):
    assert html_text.main_text(html or "") == want


def slow_article(html):
    """The pages' own build: blocks of the only article."""
    inner = re.search(r"<article>(.*?)</article>", html, re.DOTALL).group(1)
    blocks = re.split(r"</?(?:p|h1)>", inner)
    from html import unescape

    cleaned = [" ".join(unescape(re.sub(r"<[^>]*>", " " if "br" in b else "", b)).split()) for b in blocks]
    return "\n\n".join(b for b in cleaned if b)


def test_main_text_of_the_pages(spark):
    got = {r["page_id"]: r for r in queries.op8_main_text(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        want = slow_article(r["html"])
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_pages_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, None, "t"), (1, "<p>x</p>", "t")], "page_id long, html string, text string")
    assert [r["text"] for r in html_text.main_texts(pages).orderBy("html").collect()] == ["", "x"]
    assert html_text.main_texts(pages.limit(0)).count() == 0
