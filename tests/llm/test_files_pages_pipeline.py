import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from provloom.llm import htmltext, tokenfiles
from tests.llm.helpers import corpus, prose

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(VOCABULARY)
ENCODER = tokenfiles.Encoder(VOCABULARY)


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


# --- token files --------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'srevmlldtTZ 1,.é😀\n\t  \x0b\x1f<|endoftext|>") | st.characters(codec="utf-8"), max_size=30), max_size=6))
def test_ids_as_by_the_library(texts):
    ids, sizes = ENCODER.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])][: len(texts)] == [ids_of(t) for t in texts]


def test_words_on_which_polynomial_hashes_collide():
    one = "a"
    while len(one) < 2048:
        one += one.translate({97: 98, 98: 97})
    texts = [one, one.translate({97: 98, 98: 97}), f"{one} x"]
    ids, sizes = ENCODER.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [ids_of(t) for t in texts]


def test_added_tokens_and_forgetting(monkeypatch):
    e = tokenfiles.Encoder(VOCABULARY)
    monkeypatch.setattr(e, "MOST_WORDS", 5)
    for t in ("a b c d e f g h", "x<|endoftext|>y", "one two", "three four five six seven"):
        ids, sizes = e.encode([t, t])
        assert ids.tolist() == ids_of(t) * 2 and sizes.tolist() == [len(ids_of(t))] * 2


def test_a_row_group_holds_few_blocks(documents, spark, tmp_path, monkeypatch):
    """The reader holds a row group, so it must not grow with the shard."""
    monkeypatch.setattr(tokenfiles, "GROUP_BYTES", 20_000)
    rng = random.Random(3)
    path = tmp_path / "files"
    texts = {i: prose(rng, 400) for i in range(400)}
    tokenfiles.write(documents(texts.items()), VOCABULARY, str(path), block_ids=1000)
    files = [pq.ParquetFile(f).metadata for f in path.glob("*.parquet")]
    groups = [f.row_group(i) for f in files for i in range(f.num_row_groups)]
    assert sum(g.total_byte_size for g in groups) > 1_000_000
    assert max(g.total_byte_size for g in groups) < 60_000
    got = {r.doc_id: r.ids_crc32 for r in tokenfiles.read(spark, str(path)).collect()}
    assert got == {i: zlib.crc32(np.array([*ids_of(t), 0], "<u4").tobytes()) for i, t in texts.items()}


def test_files_round_trip(documents, spark, tmp_path):
    rng = random.Random(1)
    texts = {i * 7 - 50: t for i, t in enumerate(corpus(5, 80))} | {900: "it's 'll <|endoftext|> ok", 901: prose(rng, 5000)}
    path = str(tmp_path / "files")
    tokenfiles.write(documents(texts.items()), VOCABULARY, path, block_ids=500)
    got = {r.doc_id: r for r in tokenfiles.read(spark, path).collect()}
    start = 0
    for i in sorted(texts):
        ids = [*ids_of(texts[i]), 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert got[i].found_by_key
        start += len(ids)
    asked = spark.createDataFrame([(i,) for i in [*list(texts)[:20], 5, 10_000, 901]], "doc_id long")
    found = {r.doc_id: r.ids for r in tokenfiles.lookup(spark, path, asked).collect()}
    assert found == {i: [*ids_of(texts[i]), 0] for i in [*list(texts)[:20], 901]}


def test_files_of_odd_rows(documents, spark, tmp_path):
    df = documents([(1, None), (2, ""), (2, "a b"), (2, "a b"), (None, "x"), (None, None), (3, prose(random.Random(1), 20_000))], "1 AS start").selectExpr("*", "2 AS shard")
    got = sorted(((r.doc_id, r.start, r.n_tokens) for r in tokenfiles.encoded(df, VOCABULARY, str(tmp_path / "a")).collect()), key=lambda r: r[1])
    n = len(ids_of(prose(random.Random(1), 20_000))) + 1
    assert got == [(None, 0, 1), (None, 1, 2), (1, 3, 1), (2, 4, 1), (2, 5, 3), (2, 8, 3), (3, 11, n)]
    assert tokenfiles.encoded(df.limit(0), VOCABULARY, str(tmp_path / "b")).collect() == []


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 100, 5000):
        keys = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        h = tokenfiles.PerfectHash(*tokenfiles.build_hash(keys))
        assert h.n == len(keys) and sorted(h.slots(keys)) == list(range(len(keys)))


# --- pages --------------------------------------------------------------------------------------

NAV = "<nav><ul><li><a href='/a'>Home</a><li><a href='/b'>News</a></ul></nav>"


def page(rng, body, cls="story"):
    ad = prose(rng, 4)
    return (
        f"<!DOCTYPE html><html><head><title>{ad}</title><style>p{{a:b}}</style><script>if(a<b)x='</p>'</script></head><body>{NAV}"
        f"<div class='ad'>{ad}</div><div class='wrap'><div class='{cls}'>{body}</div></div><aside>{ad}</aside>"
        f"<div class='user-comments'><p>{ad}</p></div><div class='fixed'>Always the same</div><footer>&copy; us {ad}</footer></body></html>"
    )


def test_template_of_a_host_without_article_tags(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for i in range(12):
        parts = [prose(rng, rng.randint(20, 60)) for _ in range(rng.randint(1, 4))]
        rows.append((i, f"http://Host.example/p{i}", page(rng, "".join(f"<p>{p}<br>" for p in parts))))
        want[i] = "\n\n".join(parts)
    got = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.by_template and r.n_chars == len(r.text) for r in got)


def test_main_text_of_single_pages():
    text = lambda h: htmltext.main_text(h, None, [])
    assert text("<body><article><h1>T &amp; x</h1><p>one<br>two&nbsp; three<ul><li>a<li><b>b</b>c</ul></article><footer>f</footer>") == "T & x\n\none two three\n\na\n\nbc"
    assert text("<article><p><b>x<br><p>y</article>z") == "x\n\ny"
    assert text("<article><header><h1>T</h1></header><p>a<form>f<input></form><div class='comments'><p>c</div><p hidden>h</p><!-- <p>n</p> --></article>") == "T\n\na"
    assert text("<div>a<script>var t='</div>';</script>b</div>") == "ab"
    assert text("plain <unclosed") == "plain <unclosed" and text("") == ""
    assert text("<p>&lt;b&gt; &#233; &unknown; a<span>b</span></p>") == "<b> é &unknown; ab"
    assert text("<div role=navigation>m</div><div class='main-menu'>m</div><p>t</p><textarea>q</textarea>") == "t"


def test_names_and_forms_around_a_page_do_not_hide_it():
    """Wrappers whose words sound like side parts, articles behind them, and long reader comments."""
    rng = random.Random(5)
    text = lambda h: htmltext.main_text(h, None, [])
    body, ad = prose(rng, 60), prose(rng, 5)
    for wrap in ("<div class='content has-sidebar'>", "<div id='page-header-fixed'>", "<div class='site sticky-menu'>", "<section class='post related-none'>", "<form action=x>"):
        inner = f"<div class='sidebar'>{ad}</div><article><p>{body}</p></article><div class='ad'>{ad}</div>"
        assert text(f"<body>{wrap}{inner}</body>") == body
        assert text(f"<body><p>tag line</p>{wrap}<p>{body}</p><form>search</form></body>") == f"tag line\n\n{body}"
    comments = "".join(f"<article><p>{prose(rng, 80)}</p></article>" for _ in range(5))
    assert text(f"<div class='has-sidebar'><article><p>{body}</p></article></div><div class='comments'>{comments}</div>") == body
    assert text(f"<div class='comments'>{comments}</div>") == ""
    assert text(f"<p>x <span class='ad'>{ad}</span> y</p><p>{body}</p>") == f"x y\n\n{body}"


def test_hosts_whose_pages_are_alike(spark):
    rng = random.Random(6)
    same = page(rng, f"<p>{prose(rng, 40)}</p><p>{prose(rng, 30)}</p>")
    want = htmltext.main_text(same, None, [])
    copied = f"<p>{prose(rng, 30)}</p>"
    rows = [(i, f"http://a/{i}", same) for i in range(4)]
    # a host of copies and one other page, and an introduction that all its pages share
    rows += [(10 + i, f"http://b/{i}", page(rng, copied if i < 3 else f"<p>{prose(rng, 40)}</p>")) for i in range(4)]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] and set(got[i].split("\n\n")) <= set(want.split("\n\n")) and same.split("<p>")[1].split("</p>")[0] in got[i] for i in range(4))
    assert all(got[10 + i] == copied[3:-4] for i in range(3)) and got[13]


def test_pages_of_odd_rows(spark):
    rng = random.Random(2)
    long = "".join(f"<p>{prose(rng, 50)}</p>" for _ in range(400))
    rows = [(1, "http://h/a", None), (2, "http://h/b", ""), (3, None, "<p>x</p>"), (4, "no url", "<p>y</p>"), (5, "http://l/", f"<article>{long}</article>")]
    rows += [(6, "http://r/", "<article><p>same</article>")] * 3 + [(None, "http://n/", "<p>null id</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS host", "3 AS main")
    got = sorted(((r.page_id, r.text if r.page_id != 5 else "") for r in htmltext.extract(df).collect()), key=repr)
    want = [(1, ""), (2, ""), (3, "x"), (4, "y"), (5, ""), (6, "same"), (6, "same"), (6, "same"), (None, "null id")]
    assert got == sorted(want, key=repr)
    assert htmltext.extract(df.limit(0)).collect() == []
    assert htmltext.main_text("<div>" * 3000 + "deep", None, []) == "deep"


# --- entry and pipeline -------------------------------------------------------------------------


def test_all_operators_are_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n[2].isdigit()) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_pipeline_by_stages(spark, documents, tmp_path):
    """Every stage against the rule it stands for."""
    rng = random.Random(99)
    items = [(i, prose(rng, 15)) for i in range(4)]
    texts = [t for t in corpus(12, 60)] + [f"{prose(rng, 30)} {items[1][1]} {prose(rng, 9)}", "12 34 !!", None, ""]
    rows = [(i, t, "xy"[i % 2], f"s{i % 3}") for i, t in enumerate(texts)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{k}"))
        if k < 4:
            assert out.columns == docs.columns
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        kept.append(docs.collect())
    ids = [sorted(r.doc_id for r in k) for k in kept]
    assert ids[0] == [i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
    from tests.llm.test_ngram_join import expected

    group = {i: c for i, (_, c) in expected({i: texts[i] for i in ids[0]}).items()}
    assert ids[1] == sorted(set(group.values()))
    assert 60 in ids[1] and ids[2] == [i for i in ids[1] if i != 60]
    assert set(ids[3]) <= set(ids[2]) and len(ids[3]) > len(ids[2]) and max(ids[3].count(i) for i in ids[3]) <= 2
    start = 0
    for i in ids[3]:
        start += len(ids_of(texts[i])) + 1
    assert ids[4] == ids[3] and max(r.start + r.n_tokens for r in kept[4]) == start
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, kept[4]))


def test_words_are_encoded_a_few_at_a_time(monkeypatch):
    from provloom.llm import tokenfiles
    from provloom.llm.registered import VOCABULARY

    enc, calls = tokenfiles.Encoder(VOCABULARY), []
    whole = enc.encode([" ".join(f"w{i}x" for i in range(20_000))])

    class Counting:
        def __getattr__(self, name):
            return getattr(tokenizer, name)

        def encode_batch_fast(self, words, **more):
            calls.append(len(words))
            return tokenizer.encode_batch_fast(words, **more)

    tokenizer, enc.tokenizer = enc.tokenizer, Counting()
    monkeypatch.setattr(enc, "AT_ONCE", 1000, raising=False)
    enc.forget()
    again = enc.encode([" ".join(f"w{i}x" for i in range(20_000))])
    assert max(calls) <= 1000 and all((a == b).all() for a, b in zip(whole, again, strict=True))
