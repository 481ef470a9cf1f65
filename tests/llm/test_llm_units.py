"""The llm operators' kernels against plain versions; no Spark."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from webweft.llm import bpe, encode, langid, lzprint, mainhtml, nearcopies, packing, simhash
from webweft.llm.common import tokenizer_path

WORDS = tokenizer_path("word_bpe_49k.json")
HARD = [
    "", "  ", "Σίσυφος ΑΣ", "<|endoftext|>hello<|startoftext|> x<|endof", "İstanbul é a\x1cb \x1f c d　e f\x85g", "it's 're DON'T 1234 ½ ²",
    "😀👩‍👩‍👧 ok", "a" * 3000, "日本語テキスト ﷺ", "́abc ́", "#​ x ﻿ y", "ß ẞ ſt", "x\u0000y", "don't  stop",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def own():
    return bpe.WordBpe(WORDS)


def test_ids_and_decoding_equal_the_librarys(library, own):
    mine, theirs = own.encoder(), encode.library_encoder(WORDS)
    for text in [*HARD, " ".join(HARD)]:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(mine.ids_bytes(text), "<u4").tolist() == want, text
        assert np.frombuffer(theirs.ids_bytes(text), "<u4").tolist() == want, text
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_any_text_encodes_as_the_library_does(text):
    from tokenizers import Tokenizer

    global _LIBRARY
    if "_LIBRARY" not in globals():
        _LIBRARY = (Tokenizer.from_file(WORDS), bpe.WordBpe(WORDS))
    library, own = _LIBRARY
    assert np.frombuffer(own.encoder().ids_bytes(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_settled_letters_split_as_the_library_splits_them():
    splitter, rng = encode.WordSplitter(WORDS), random.Random(5)
    letters = [chr(c) for c in range(0x20, 0x460) if encode._SETTLED(chr(c))]
    drawn = ["".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(3000)]
    for part in [*letters, *("a" + c + "b" for c in letters), *("7" + c + "'s" for c in letters), *drawn]:
        assert splitter.words(part) == [s for s, _ in splitter._split(splitter._normalized(part))], part


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.integers(0, 10_000))
def test_merges_equal_a_plain_search(symbols, seed):
    rng = random.Random(seed)
    pairs = rng.sample([(a, b) for a in range(8) for b in range(8)], 12)
    ranks, made = {a << 32 | b: i for i, (a, b) in enumerate(pairs)}, [rng.randrange(8) for _ in pairs]
    plain = list(symbols)
    while True:
        best = min(((ranks[a << 32 | b], i) for i, (a, b) in enumerate(zip(plain, plain[1:])) if a << 32 | b in ranks), default=None)
        if best is None or len(plain) < 2:
            break
        plain[best[1] : best[1] + 2] = [made[best[0]]]
    assert bpe.merge_symbols(list(symbols), ranks, made) == plain


def check_packing(lengths, sequence, offset, capacity):
    for s in set(sequence.tolist()):
        own = sorted((offset[i], lengths[i]) for i in np.flatnonzero(sequence == s))
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) <= capacity


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_packings_are_sound_and_tight(lengths):
    lengths = np.array(sorted(lengths, reverse=True), np.int64)
    for pack in (packing.sum_of_squares, packing.best_fit_decreasing):
        sequence, offset = pack(lengths, 16)
        check_packing(lengths, sequence, offset, 16)
        used = len(set(sequence.tolist()))
        assert used <= 11 / 9 * max(1, -(-int(lengths.sum()) // 16)) + 3


def test_sum_of_squares_rule():
    # Gaps 6 and 4 are open once each; a piece of 4 closes the gap of 4 (change -1), rather than turn 6 into 2 (0).
    sequence, _ = packing.sum_of_squares(np.array([6, 4, 4]), 10)
    assert sequence.tolist() == [0, 0, 1]
    # Two gaps of 5 count 4; taking 3 from one of them leaves one 5 and one 2, which count 2.
    sequence, offset = packing.sum_of_squares(np.array([7, 7, 2]), 12)
    assert (sequence.tolist(), offset.tolist()) == ([0, 1, 1], [0, 0, 7])


def test_residual_tree_finds_the_smallest_that_fits():
    rng = random.Random(3)
    tree, plain = packing.ResidualTree(50), []
    for k in range(600):
        if rng.random() < 0.5:
            r = rng.randint(1, 50)
            tree.add(r, k)
            plain.append(r)
        else:
            least = rng.randint(1, 50)
            want = min((r for r in plain if r >= least), default=None)
            got = tree.take(least)
            assert (got and got[0]) == want
            if want:
                plain.remove(want)


def test_simhash_equals_its_definition():
    import xxhash

    for text in ["", " \t", "one", "A b C d", "The Quick brown fox jumps över the lazy DOG again and again", "a a a a a a a a"]:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.majority(simhash.shingle_hashes(text.encode(), 4)) == want


def test_bk_tree_and_local_links():
    rng = random.Random(5)
    centers = [rng.getrandbits(64) for _ in range(20)]
    values = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centers for _ in range(10)})
    tree = simhash.BkTree()
    for v in values:
        tree.add(v)
    for v in values[:40]:
        assert sorted(tree.within(v, 4)) == sorted(x for x in values if (x ^ v).bit_count() <= 4)

    def groups(pairs):
        up = {v: v for v in values}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[max(root(a), root(b))] = min(root(a), root(b))
        return {v: root(v) for v in values}

    links = simhash.local_links(values, 4)
    assert len(links) < len(values)
    assert groups(links) == groups([(a, b) for a, b in combinations(values, 2) if (a ^ b).bit_count() <= 4])


def test_local_set_links_equal_exact_similarity():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(3000)]
    texts = []
    for n in (6, 9, 40, 400):  # few words too: the fingerprints of small sets differ most
        base = [rng.choice(words) for _ in range(n)]
        for k in range(12):
            texts.append(" ".join([*base, *(rng.choice(words) for _ in range(k * n // 30))]))
    values = list(dict.fromkeys(nearcopies.packed(nearcopies.shingle_set(t.encode())) for t in texts))
    sets = [set(np.frombuffer(v, "<u8", offset=8).tolist()) for v in values]

    def groups(pairs):
        up = list(range(len(values)))
        for a, b in pairs:
            old, new = up[a], up[b]
            up = [new if x == old else x for x in up]
        return {frozenset(i for i, x in enumerate(up) if x == g) for g in up}

    number = {v: i for i, v in enumerate(values)}
    exact = [(a, b) for a, b in combinations(range(len(values)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    links = nearcopies.local_set_links(values, 0.8)
    assert len(links) < len(values) and groups((number[a], number[b]) for a, b in links) == groups(exact)


def test_bands_for_make_small_shards():
    assert simhash.bands_for(10**6, 4) == 6 and simhash.bands_for(10**11, 4) == 7 and simhash.bands_for(10**12, 4) == 8


def test_main_text_outside_articles_and_in_misnamed_parts():
    prose = "The cat sat on the mat and it was good for all of us. " * 5
    want = f"{prose.strip()} {prose.strip()}"
    teaser = "<article><h3>Read this</h3><p>Short teaser.</p></article>"
    assert mainhtml.main_text(f"<body><div><p>{prose}</p><p>{prose}</p></div>{teaser}</body>").startswith(want)
    assert mainhtml.main_text(f"<body><article><p>{prose}</p><p>© 2020 Site</p><p>{prose}</p></article></body>") == want
    for name in ("layout has-sidebar", "elementor-widget-container", "post has-comments", "no-ad"):
        page = f"<body><div class='{name}'><article><p>{prose}</p><p>{prose}</p></article><div class='sidebar'>{prose}</div></div><div>© x</div></body>"
        assert mainhtml.main_text(page) == want
    comments = f"<section id='comments'><p>{prose}</p><p>{prose}</p></section>"
    assert mainhtml.main_text(f"<body><article><p>{prose}</p><p>{prose}</p></article>{comments}</body>") == want


def test_phrases_are_those_of_lz78():
    for text in ["", "a", "aaaaaa", "abababababa", "the cat the cat the dog", "é日本é日本é日"]:
        seen, phrase, want = [], "", set()
        for c in text:
            phrase += c
            if phrase not in want:
                want.add(phrase)
                seen.append(phrase)
                phrase = ""
        ends: list[int] = []
        got: set[str] = set()
        lzprint.phrase_ends(text, got, ends, 0, "")
        assert got == want and [len(s) for s in seen] == np.diff([0, *ends]).tolist()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc é", max_size=80), st.text(alphabet="abc é", max_size=80))
def test_edited_fingerprints_equal_those_of_the_edited_text(text, following):
    parsed = lzprint._Parsed(1, text)
    edited, hashes = parsed.edited(following)
    assert edited == text[: len(text) - len(text) // 2] + following[: len(text) // 2]
    assert lzprint.hex_of(hashes) == lzprint.hex_of(lzprint.fingerprint(edited))
    assert lzprint.hex_of(parsed.hashes) == lzprint.hex_of(lzprint.fingerprint(text))
    assert lzprint.likeness(hashes, hashes) == 1.0


def test_likeness_is_exact_for_small_sets():
    a, b = lzprint.fingerprint("abcd"), lzprint.fingerprint("abxy")
    assert lzprint.likeness(a, b) == pytest.approx(2 / 6)
    assert lzprint.likeness(a, lzprint.fingerprint(None)) == 0.0 and lzprint.likeness(a[:0], a[:0]) == 1.0


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 8, 12):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code.tolist()}) == n
    assert langid.codewords(4).shape == (4, 7)
    assert min((langid.codewords(4)[i] != langid.codewords(4)[j]).sum() for i, j in combinations(range(4), 2)) == 4


def test_languages_are_told_apart():
    rng = random.Random(2)
    vocab = {lang: ["".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(80)] for lang, letters in (("xx", "abcdef"), ("yy", "defghi"), ("zz", "ghijkl"))}
    rows = [(" ".join(rng.choices(v, k=rng.randint(3, 40))), lang) for lang, v in vocab.items() for _ in range(60)]
    model = langid.fit(rows)
    test = [(" ".join(rng.choices(v, k=20)), lang) for lang, v in vocab.items() for _ in range(30)]
    assert sum(model.predict(t)[0] == lang for t, lang in test) >= 0.98 * len(test)
    assert model.predict("12 34 !!") == ("und", 0.0, True) and model.predict(None)[0] == "und"
    assert langid.fit([]).predict("text")[0] == "und" and langid.fit([("abc", "xx")]).predict("text") == ("xx", 1.0, False)


PAGE = """<html><head><title>T</title></head><body><header class="site-header"><h1>Site</h1></header><div id="cookie-notice">We use cookies to make this
the best site for you.</div><nav><a href=1>Home</a></nav><div class="content"><article class="post"><h2 class="entry-header">Title &amp; more</h2>
<p>One  two<br>three.</p><p>See <a href=x>this link</a></p><ul class=share><li><a>tw</a></ul><ul><li>item one<li>item two</ul><form><input><label>x</label>Sub</form>
<div class="sidebar">S</div><blockquote>q <b>bold</b>word</blockquote><script>if (a<b) {"</p>"}</script><section id="comments"><p>Great post!</p></section></article></div>
<aside>side</aside><div class="advert">Buy</div><footer>&copy; x</footer></body></html>"""


def test_main_text():
    assert mainhtml.main_text(PAGE) == "Title & more One two three. See this link item one item two q boldword"
    assert mainhtml.main_text(None) == mainhtml.main_text("") == mainhtml.main_text("<nav>x</nav>") == ""
    prose = "The cat sat on the mat and it was good for all of us. " * 5
    bare = f"<body><div><a href=1>Home</a> <a href=2>News</a></div><h1>Heading</h1><p>{prose}</p><p>Short one.</p><p>{prose}</p><p>© 2020 x</p></body>"
    assert mainhtml.main_text(bare) == f"Heading {prose.strip()} Short one. {prose.strip()}"


def test_main_text_of_odd_pages():
    prose = ("The cat sat on the mat and it was good for all of us. " * 5).strip()
    assert mainhtml.main_text(f"<article><a name=top><p>{prose}</p><p>{prose}</p></article>") == f"{prose} {prose}"  # a mark, never closed
    unclosed = mainhtml.main_text(f"<article><p>{prose}</p><p>See <a href=x>more<p>{prose}</p><p>{prose}</p></article>")
    assert unclosed == f"{prose} See more {prose} {prose}"
    foreign = "これは日本語の文章です。今日は天気がとても良いので散歩に行きました。" * 18
    assert mainhtml.main_text(f"<nav><a href=/>x</a></nav><div><p>{foreign} <a href=/b>続き</a></p></div>") == f"{foreign} 続き"
    named = f"<main><p>{prose}</p><div class=tags-explained><p>{prose}</p></div><div id=ad-hoc-teams><p>{prose}</p></div><div class='col ad-box-2'>{prose}</div></main>"
    assert mainhtml.main_text(named) == f"{prose} {prose} {prose}"
    assert mainhtml.main_text(f"<article><p>{prose} And <math><mi>x</mi></math> is it.</p></article>") == f"{prose} And x is it."
    assert mainhtml.main_text(f"<article>{'<div>' * 3000}{prose}{'</div>' * 3000}</article>") == prose


def test_both_passes_decide_blocks_in_articles(monkeypatch):
    asked = []
    monkeypatch.setattr(mainhtml, "stop_density", lambda text, real=mainhtml.stop_density: asked.append(text) or real(text))
    prose = "The cat sat on the mat and it was good for all of us. " * 5
    page = mainhtml.blocks(f"<body><article><h1>Heading</h1><p>{prose}</p><p><a href=x>All of our offers</a></p><p>{prose}</p></article><div>{prose}</div><p><a href=y>Imprint of the site</a></p></body>")
    mainhtml.first_pass(page)
    assert asked and [b.label for b in page].count(mainhtml.SHORT_BLOCK) == 1
    mainhtml.second_pass(page)
    assert [b.label for b in page] == ["good", "good", "good", "good", "good", "bad"]


def test_packing_of_lengths_that_never_fill_stays_bounded(monkeypatch):
    """Documents of 1,100 tokens: half of each sequence stays empty, and no task may wait for better ones."""
    import pyarrow as pa

    runs = []
    pack = packing.best_fit_decreasing
    monkeypatch.setattr(packing, "best_fit_decreasing", lambda lengths, capacity: runs.append(int(lengths.sum())) or pack(lengths, capacity))

    class Frame:
        """Takes the place of a table: keeps the function of the map."""

        def __getitem__(self, name):
            return self

        def cast(self, _):
            return self

        alias = cast

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    run = packing.pack_best_fit_decreasing(Frame(), block_tokens=40_000)
    texts = [" ".join(["the"] * (1099 if i % 7 else 5000)) for i in range(300)]
    out = [b for b in run([pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(texts)], ["doc_id", "text"])])]
    parts = {}
    for b in out:
        for r in b.to_pylist():
            for d, at, a, z in zip(r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
                parts.setdefault(d, []).append((at, np.frombuffer(r["ids"], "<u2")[a:z].tolist()))
    one = encode.library_encoder(WORDS).ids_bytes("the")
    the = int(np.frombuffer(one, "<u4")[0])
    for d, own in parts.items():  # every document, put together again
        assert [x for _, ids in sorted(own) for x in ids] == [the] * (1099 if d % 7 else 5000) + [0]
    assert len(parts) == 300 and max(runs) <= 40_000 + 5001 and len(runs) <= 40


def test_code_points_encode_as_the_librarys(library, own):
    encoder = own.encoder()
    odd = [0x558, 0x58B, 0x88F, 0x1C89, 0x209D, 0xA7CB, 0x10D60, 0x18E1E, 0x130, 0x3A3, 0x1E9E, 0xFB03, 0x2126, 0x85, 0x2028]
    for c in [*odd, *(x for x in range(0x20, 0x30000, 37) if not 0xD800 <= x < 0xE000)]:
        text = f"a{chr(c)}B c{chr(c)}"
        assert np.frombuffer(encoder.ids_bytes(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, hex(c)


def test_every_language_is_sampled_within_bounds():
    for n in (1, 4, 201, 5000, 10**6):
        rows, chars = langid.sample_bounds(n)
        assert rows >= 1 and chars >= 1 and (n > langid.MOST_ROWS or rows * n <= langid.MOST_ROWS and rows * n * chars <= langid.MOST_CHARS)


def test_vocabularies_with_another_normalizer_are_refused(tmp_path):
    import json

    spec = json.load(open(WORDS, encoding="utf-8"))
    spec["normalizer"] = {"type": "NFKC"}
    (tmp_path / "other.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="normalize"):
        bpe.WordBpe(str(tmp_path / "other.json"))
