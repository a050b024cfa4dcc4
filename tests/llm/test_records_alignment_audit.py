"""Record files, cross-tokenizer alignment and the filter audit against brute force and on odd rows."""

import hashlib
import re
import struct
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyarrow import fs as pafs
from tokenizers import Tokenizer

from verdigris.llm import alignment, audit, records
from verdigris.llm import queries as Q

LONG = "word, " * 3000 + "x" * 40_000 + "Élan-vital's " * 500
ODD = [
    (1, None, "en", "b"), (2, "", "en", None), (3, " \n\t\r ", "fr", "a"), (4, "a b c d e f", None, "a"), (4, "a b c d e f", None, "a"), (4, "a b c d e f", "fr", "a"), (5, LONG, "de", "b"), (None, "a b c d e f", "en", "c"),
    (6, "mail <|endoftext|>x.y@ex.com <|startoftext|> $ 100% 'S it's we'll. 3,5", "en", "c"), (7, "ABC DEF ghi #1", "en", "c"),
    (8, "é  ñ \U0001f600 \x0b\x0c\x1c\x85 don't  \n\n x́ ﬁ Σς İ ①", "es", "c"), (9, "\n".join(["same line here"] * 60), "", "a"), (-3, "</s> <unk> <0x41> A ▁ x", "en", "c"), (10, None, None, "a"),
]
DOCS = "doc_id long, text string, lang string, source string"
WORDS, A, B = (P.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_checksum_of_known_strings():
    sums = records.Checksum()
    # Published check values of CRC-32C.
    known = {b"": 0, b"a": 0xC1D04330, b"123456789": 0xE3069283, b"\0" * 32: 0x8A9136AA, b"\xff" * 32: 0x62A8AB43, bytes(range(32)): 0x46DD794E}
    assert sums.of(list(known)).tolist() == list(known.values())
    rng = np.random.default_rng(3)
    data = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in [*range(70), 1000, 4097, 100_003]]
    slow = [sums._short(x) for x in data]
    assert sums.of(data).tolist() == slow
    assert sums.masked([b"123456789"]).tolist() == [(((0xE3069283 >> 15) | (0xE3069283 << 17)) + 0xA282EAD8) & 0xFFFFFFFF]


def word_ids(texts):
    t = Tokenizer.from_file(WORDS)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


def test_word_encoder_equals_library():
    with open(WORDS) as f:
        spec = f.read()
    encoder = records.WordEncoder(spec)
    assert encoder.by_run
    rng = np.random.default_rng(5)
    parts = ["don't", "'s", "a.", "b,", "...", "x!?", "É.", "É.", "́.", "1.", "ab1;", " ", "  ", "\n", "\t", "\r\n", "<|endoftext|>", "<|endoftext|", ">", "İ.", "\u0958.", "\u1100", "\u1161.", "Σ", "\xa0", " ", "​", "日本。", "語.", "ʰ.", "'", "'ll.", "we'll"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(3000)] + [t for _, t, *_ in ODD if t]
    want = [x[:-1] for x in word_ids(texts)]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want
    whole = records.WordEncoder(open(A).read())
    assert not whole.by_run
    assert np.frombuffer(whole.encode(["a b"])[0], "<u4").tolist() == Tokenizer.from_file(A).encode("a b").ids


def expected_records(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    ids = word_ids([t for _, t in rows])
    start, out = 0, []
    for (i, _), x in zip(rows, ids, strict=True):
        out.append((i, start, len(x), np.array(x, "<u4").tobytes()))
        start += len(x)
    return out


def test_records_round_trip(spark, documents, tmp_path):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    path = f"file://{tmp_path}/r"
    records.write(documents.repartition(5), WORDS, path)
    got = sorted(map(tuple, records.load(spark, path).collect()))
    assert got == expected_records(rows)
    assert records.manifest(spark, path).agg({"records": "sum", "tokens": "sum"}).first()[:] in [(len(rows), sum(r[2] for r in got)), (sum(r[2] for r in got), len(rows))]
    mixed = records.shuffled(spark, path, 7)
    again = [r["doc_id"] for r in sorted(mixed.collect(), key=lambda r: r["place"])]
    assert sorted(map(tuple, mixed.drop("place").collect())) == got
    assert again != sorted(again) and again == [r["doc_id"] for r in sorted(records.shuffled(spark, path, 7).collect(), key=lambda r: r["place"])]
    assert again != [r["doc_id"] for r in sorted(records.shuffled(spark, path, 8).collect(), key=lambda r: r["place"])]


def test_record_files_have_the_stated_form(spark, documents, tmp_path):
    """The bytes of the files read by plain Python, in order."""
    records.write(documents, WORDS, f"file://{tmp_path}/r")
    sums, found = records.Checksum(), []
    mask = lambda x: int(sums.masked([x])[0])
    for f in sorted(spark.read.parquet(f"{tmp_path}/r/manifest").collect()):
        data, index = ((tmp_path / "r" / (f["file"] + end)).read_bytes() for end in ("", ".idx"))
        at = tokens = 0
        places = []
        while at < len(data):
            n, head = struct.unpack_from("<QI", data, at)
            body = data[at + 12 : at + 12 + n]
            assert head == mask(data[at : at + 8]) and struct.unpack_from("<I", data, at + 12 + n)[0] == mask(body)
            places.append((at, tokens))
            width, null, doc_id = struct.unpack_from("<HHq", body)
            ids = np.frombuffer(body[12:], f"<u{width}")
            assert width == 2 and ids[-1] == 2
            found.append((None if null else doc_id, ids.tolist()))
            at, tokens = at + 16 + n, tokens + len(ids)
        assert places + [(at, tokens)] == [tuple(x) for x in np.frombuffer(index, records.ENTRY).tolist()]
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert found == [(r[0], np.frombuffer(r[3], "<u4").tolist()) for r in expected_records(rows)]


def test_records_of_odd_rows(spark, odd, tmp_path):
    clash = odd.selectExpr("doc_id", "text", "1 AS tie", "2 AS START", "'x' AS token_ids")
    records.write(clash, WORDS, f"file://{tmp_path}/odd")
    got = sorted(map(tuple, records.load(spark, f"file://{tmp_path}/odd").collect()), key=lambda r: r[1])
    want = expected_records([r[:2] for r in ODD])
    assert [r[1] + r[2] for r in got[:-1]] == [r[1] for r in got[1:]] and got[0][1] == 0
    assert [r[0] for r in got] == [r[0] for r in want]
    assert sorted((str(r[0]), r[3]) for r in got) == sorted((str(r[0]), r[3]) for r in want)
    records.write(odd.limit(0), WORDS, f"file://{tmp_path}/none")
    assert records.load(spark, f"file://{tmp_path}/none").count() == 0
    assert records.shuffled(spark, f"file://{tmp_path}/none", 1).count() == 0
    assert records.load(spark, f"file://{tmp_path}/none").columns == ["doc_id", "start", "n_tokens", "token_ids"]


def test_parts_of_a_file_and_broken_records(spark, documents, tmp_path, monkeypatch):
    records.write(documents.coalesce(1), WORDS, f"file://{tmp_path}/r")
    want = sorted(map(tuple, records.load(spark, f"file://{tmp_path}/r").collect()))
    monkeypatch.setattr(records, "SPLIT", 1000)
    assert sorted(map(tuple, records.load(spark, f"file://{tmp_path}/r").collect())) == want
    name = spark.read.parquet(f"{tmp_path}/r/manifest").first()["file"]
    file = tmp_path / "r" / name
    data = bytearray(file.read_bytes())
    data[40] ^= 1
    file.write_bytes(bytes(data))
    with pytest.raises(Exception, match=f"{name} from record 0: record 0 of the run has a wrong checksum"):
        records.load(spark, f"file://{tmp_path}/r").collect()


def test_query_of_records(spark, sf, documents):
    got = sorted(map(tuple, Q.op11_token_records(spark, sf).collect()))
    assert got == [(i, s, n, zlib.crc32(x)) for i, s, n, x in expected_records([tuple(r) for r in documents.select("doc_id", "text").collect()])]


def brute_alignment(rows):
    a_tok, b_tok = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True
    letters = alignment.byte_letters()
    out, links_of, counts = [], [], Counter()
    for i, text in rows:
        a = b = []
        links, groups = [], []
        if text:
            a = a_tok.encode(" " + text, add_special_tokens=False).ids
            b = b_tok.encode(text)
            raw_a = [bytes(letters[c] for c in a_tok.id_to_token(x)) for x in a]
            raw_b = [bytes([int(b_tok.id_to_piece(x)[3:5], 16)]) if b_tok.is_byte(x) else b_tok.id_to_piece(x).replace("▁", " ").encode() for x in b]
            if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
                a, b = [], []
            else:
                ends = [np.cumsum([len(x) for x in raw]).tolist() for raw in (raw_a, raw_b)]
                shared = sorted(set(ends[0]) & set(ends[1]))
                p = q = 0
                for e in shared:
                    pa, qb = p, q
                    while p < len(a) and ends[0][p] <= e:
                        p += 1
                    while q < len(b) and ends[1][q] <= e:
                        q += 1
                    groups.append((a[pa:p], b[qb:q]))
                    for x in range(pa, p):
                        for y in range(qb, q):
                            if max(ends[0][x] - len(raw_a[x]), ends[1][y] - len(raw_b[y])) < min(ends[0][x], ends[1][y]):
                                links.append((a[x], b[y]))
        counts.update(links)
        links_of.append(links)
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((i, len(a), len(b), len(groups), len(links), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(*row, sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links)) for row, links in zip(out, links_of, strict=True)]


def by_text(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("held", [alignment.HELD, 0])
def test_alignment_equals_brute_force(spark, odd, documents, held):
    more = documents.select("doc_id", "text").limit(40).unionByName(odd.select("doc_id", "text"))
    got = alignment.alignment(more, A, B, P.PATTERN, held)
    assert by_text(got.collect()) == by_text(brute_alignment([tuple(r) for r in more.collect()]))
    empty = alignment.alignment(odd.limit(0), A, B, P.PATTERN, held)
    assert empty.count() == 0 and empty.columns == got.columns
    clash = odd.selectExpr("doc_id", "text", "1 AS N_A", "2 AS row", "3 AS pair")
    assert by_text(alignment.alignment(clash, A, B, P.PATTERN, held).collect()) == by_text(brute_alignment([r[:2] for r in ODD]))


def test_alignment_identity_map():
    a, b = [b" a", b"b", b"x", b""], [b"x", b"b", b"b", b" a", b"x"]
    assert alignment.identity(a, b, [True, False, False, False, False]).tolist() == [3, 1, 4, -1]
    assert alignment.identity(a, [b"x"], [True]).tolist() == [-1, -1, 0, -1]


def test_alignment_query(spark, sf, documents):
    got = Q.op12_alignment(spark, sf)
    assert by_text(got.collect()) == by_text(brute_alignment([tuple(r) for r in documents.select("doc_id", "text").collect()]))


def brute_audit(docs, labels):
    first, fails = {}, []
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, t, part in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": t in first and (i is None or i > first[t])}
        fails.append((part or "", {k for k, v in f.items() if v}, any(d == i and q == 1 for d, q, _ in labels if d is not None), any(d == i and x == 1 for d, _, x in labels if d is not None)))
    out = []
    for part in {p for p, *_ in fails}:
        mine = [x for x in fails if x[0] == part]
        rows, worth = [], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [x for x in left if name in x[1]]
                left = [x for x in left if name not in x[1]]
                worth[name] += len(gone)
                rows.append((part, order, step, len(left), len(gone), sum(name in x[1] for x in mine) - len(gone), sum(x[1] == {name} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)))
        out += [(*r, worth[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def test_audit_of_odd_rows(spark, odd):
    labels = [(1, 1, 0), (4, 1, 1), (4, 0, 0), (5, None, 1), (None, 1, 1), (8, 1, None), (77, 1, 1)]
    flags = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.interactions(audit.cells(odd, flags))
    assert sorted(map(tuple, got.collect())) == brute_audit([r[:3] for r in ODD], labels)
    clash = odd.withColumn("code", odd["lang"]).withColumn("GOOD", odd["lang"]).withColumn("n", odd["lang"]).withColumn("part", odd["text"])
    assert sorted(map(tuple, audit.interactions(audit.cells(clash, flags)).collect())) == sorted(map(tuple, got.collect()))
    assert audit.interactions(audit.cells(odd.limit(0), flags)).count() == 0
    bare = audit.interactions(audit.cells(odd, flags.limit(0)))
    assert bare.agg({"good_lost": "max"}).first()[0] == 0


def test_audit_of_many_copies(spark, documents):
    """A text that a third of all rows hold, in two parts."""
    rows = [(i, "copy " * 3, "en" if i % 3 else "fr") for i in range(600)] + [(1000 + i, f"text {i % 5} " * 120, "en") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    flags = spark.createDataFrame([(i, i % 2, i % 5 == 0) for i in range(0, 2000, 3)], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "cast(toxic as int) toxic")
    got = sorted(map(tuple, audit.interactions(audit.cells(docs, flags)).collect()))
    assert got == brute_audit(rows, [tuple(r) for r in flags.collect()])


def test_audit_sums(spark, sf):
    got = Q.op13_filter_audit(spark, sf).toPandas()
    assert len(got) == 600 * got["part"].nunique()
    last = got[got["step"] == 5].groupby("part")["kept"]
    assert (last.min() == last.max()).all()
    whole = got.groupby(["part", "filter_order"]).agg(gone=("removed", "sum"), kept=("kept", "min"))
    assert (whole["gone"] + whole["kept"]).groupby("part").nunique().eq(1).all()


def test_record_files_are_reached_by_uri(tmp_path):
    store, root = records.place(f"file://{tmp_path}")
    assert isinstance(store, pafs.LocalFileSystem) and root == str(tmp_path)
