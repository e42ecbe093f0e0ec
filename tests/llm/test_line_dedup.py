import random

from tarnspark.llm import line_dedup

rnd = random.Random(3)


def sentence(n=6):
    return " ".join("".join(rnd.choice("abcdefghé") for _ in range(rnd.randrange(2, 9))) for _ in range(n)) + "."


def prose(n):
    return "".join(sentence() + rnd.choice([" ", " ", "\n"]) for _ in range(n)).strip()


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, s int")
    return {(r.doc_id): r for r in line_dedup.dedup_lines(df).collect()}


def test_shared_passages_go_and_clean_texts_stay(spark):
    passage = prose(12)
    clean = {k: prose(20) for k in range(20)}
    rows = list(clean.items())
    carriers = {}
    for k in range(100, 110):
        own = [prose(5), prose(5)]
        carriers[k] = own
        rows.append((k, own[0] + rnd.choice([" ", "\n", " mid sentence "]) + passage + " " + own[1]))
    got = run(spark, rows)
    assert all(got[k].text == t and got[k].removed_bytes == 0 for k, t in clean.items())
    assert passage in got[100].text  # the first occurrence
    words = passage.split()
    for k in range(101, 110):
        assert all(own in got[k].text for own in carriers[k])
        gone = sum(" ".join(words[i : i + 5]) not in got[k].text for i in range(len(words) - 4))
        assert gone >= 0.9 * (len(words) - 4)


def test_copies_become_empty_and_bytes_add_up(spark):
    t = prose(30)
    got = run(spark, [(5, t), (2, t), (9, "intro words here. " + t)])
    assert got[2].text == t and got[5].text == "" and got[9].removed_bytes >= 0.95 * len(t.encode())
    assert got[9].text.startswith("intro words here.")


def test_repeats_within_a_text_and_odd_rows(spark):
    p = prose(10)
    long = " ".join(prose(3) for _ in range(3000))
    rows = [(1, p + "\n" + prose(3) + "\n" + p), (2, None), (3, ""), (4, " \n "), (None, p), (7, long), (8, "De " * 500), (8, "De " * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.dedup_lines(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].text.count(p) == 1 and by[2].text is None and by[3].text == "" and by[4].text == " \n " and by[7].text == long
    assert by[None].text == ""  # a null id comes last
    assert {r.text for r in got if r.doc_id == 8} == {"De " * 500}  # equal rows are one document
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_equal_hashes_of_different_bytes_stay():
    assert line_dedup.remove_runs(b"abc def", [(0, 3, b"abd", 0)]) == (b"abc def", [])


def test_growth_stops_at_words():
    text, first = b"x same words here yes", b"q same words here yet"
    assert line_dedup.remove_runs(text, [(2, 12, first, 2)])[0] == b"x yes"


def test_growth_reads_context_as_a_whole():
    """Context is compared in one piece each way, not byte by byte, and as far as a byte loop would."""

    class Counted(bytes):
        reads = 0

        def __getitem__(self, at):
            Counted.reads += 1
            return bytes.__getitem__(self, at)

    own = b" ".join(b"word%d" % k for k in range(400))
    s, e = own.index(b"word200"), own.index(b"word201") - 1
    assert line_dedup._grow(Counted(own), s, e, own, s) == (0, len(own)) and Counted.reads < 20
    for _ in range(500):
        run, (x, y), (u, v) = b"run of words", *([b"".join(rnd.choice([b"a", b"b", b" "]) for _ in range(rnd.randrange(12))) for _ in range(2)] for _ in range(2))
        i, j = 0, 0
        while i < min(len(x), len(u)) and x[-i - 1] == u[-i - 1]:
            i += 1
        while j < min(len(y), len(v)) and y[j] == v[j]:
            j += 1
        assert line_dedup._alike(x[len(x) - min(len(x), len(u)) :], u[len(u) - min(len(x), len(u)) :], "big") == i
        assert line_dedup._alike(y[: min(len(y), len(v))], v[: min(len(y), len(v))], "little") == j
        a, b = line_dedup._grow(x + run + y, len(x), len(x) + len(run), u + run + v, len(u))
        assert len(x) - i <= a <= len(x) and len(x) + len(run) <= b <= len(x) + len(run) + j


def test_chunks_and_grams_share_words(monkeypatch):
    """Words and hashes of a slice are made once for both; with or without them the result is the same."""
    import numpy as np

    texts = [prose(9).encode(), b"", b"\n\n one. two\nthree", b"\n" + prose(40).encode() + b"\n \n", " ".join(plain(120)).encode()]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    found = line_dedup.words_of(data, at)
    apart = line_dedup.chunk_slice(data, at), line_dedup.gram_slice(data, at)
    monkeypatch.setattr(line_dedup._text, "words", None)
    monkeypatch.setattr(line_dedup._text, "RangeHash", None)
    for one, other in zip(apart, (line_dedup.chunk_slice(data, at, found), line_dedup.gram_slice(data, at, found)), strict=True):
        assert all(np.array_equal(x, y) for x, y in zip(one, other, strict=True)) and len(one[0])


def test_inserted_line_moves_boundaries_only_nearby():
    import numpy as np

    a = prose(200)
    b = sentence() + " " + a

    def hashes(t):
        d = np.frombuffer(t.encode(), np.uint8)
        return set(line_dedup.chunk_slice(d, np.array([0, len(d)]))[3].tolist())

    assert len(hashes(a) & hashes(b)) >= len(hashes(a)) - 3


def plain(n):
    return ["".join(rnd.choice("abcdefghé") for _ in range(rnd.randrange(2, 9))) for _ in range(n)]


def test_any_fifty_words_share_a_gram_inside():
    import numpy as np

    def grams(words, a, b):
        text = " ".join(words).encode()
        _, s, e, h, *_ = line_dedup.gram_slice(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        lo, hi = len(" ".join(words[:a]).encode()), len(" ".join(words[:b]).encode())
        return {x for x, i, j in zip(h.tolist(), s.tolist(), e.tolist(), strict=True) if i >= lo and j <= hi}

    for _ in range(200):
        p = rnd.choice([plain(50), plain(50), (plain(rnd.randrange(1, 40)) * 50)[:50]])
        both = []
        for _ in range(2):
            a = rnd.randrange(0, 90)
            before = (p * 4)[-a:] if a and rnd.random() < 0.2 else plain(a)
            both.append(grams(before + p + plain(rnd.randrange(0, 90)), a, a + 50))
        assert both[0] & both[1]


def test_passages_without_sentences_go(spark):
    passage = plain(51)
    own = {k: (plain(rnd.randrange(30, 90)), plain(rnd.randrange(30, 90))) for k in range(12)}
    got = run(spark, [(k, " ".join([*a, *passage, *b])) for k, (a, b) in own.items()])
    assert " ".join(passage) in got[0].text and got[0].removed_bytes == 0
    for k in range(1, 12):
        assert got[k].text == " ".join([*own[k][0], *own[k][1]])


def test_long_words_are_compared_to_the_end(spark):
    """A shared passage whose words are thousands of bytes long goes as a whole."""
    passage = ["".join(rnd.choice("abcdefgh") for _ in range(1500)) for _ in range(60)]
    got = run(spark, [(1, " ".join(["start", *passage, "end"])), (2, " ".join(["other", *passage, "close"]))])
    assert got[2].text == "other close" and got[1].removed_bytes == 0


def test_against_brute_force(spark):
    """What goes stands elsewhere byte for byte, what stays is the rest, and no 50 words of what stays stand in another text that stays."""
    passages = [plain(n) for n in (50, 51, 60, 120)] + [prose(9).split()]
    rows = []
    for k in range(40):
        words = plain(rnd.randrange(20, 80))
        for p in rnd.sample(passages, rnd.randrange(0, 3)):
            words += p + plain(rnd.randrange(1, 40))
        rows.append((k, " ".join(words)))
    rows += [(100 + k, rows[k][1]) for k in range(5)]
    got, texts = run(spark, rows), dict(rows)
    seen = {}
    for d, r in got.items():
        raw = texts[d].encode()
        for x in r.removed_spans:
            piece = raw[x.start : x.end].strip()
            assert any(piece in t.encode() for o, t in texts.items() if o != d) or raw.count(piece) > 1
        gone = sum(x.end - x.start for x in r.removed_spans)
        assert gone == r.removed_bytes and len(raw) - gone >= len((r.text or "").encode()) >= len(raw) - gone - 2 * len(r.removed_spans)
        words = (r.text or "").split()
        for i in range(len(words) - 49):
            assert seen.setdefault(" ".join(words[i : i + 50]), d) == d
    assert all(got[k].text == t for k, t in rows if not any(" ".join(p[:50]) in t for p in passages) and 5 <= k < 100)


def test_columns_with_clashing_names_pass_through(spark):
    names = ["_k1", "_k2", "_r1", "_r2", "_may", "_new", "_runs", "_slot", "_word", "_bits", "h", "n"]
    t = prose(12)
    df = spark.createDataFrame([(k, f"{sentence()} {t}", *range(k, k + len(names))) for k in range(4)], f"doc_id long, text string, {', '.join(f'{n} long' for n in names)}")
    got = line_dedup.deduplicated(df).collect()
    assert all([r[n] for n in names] == list(range(r.doc_id, r.doc_id + len(names))) for r in got) and sum(bool(r._spans) for r in got) == 3
