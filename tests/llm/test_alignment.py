"""Alignment of two tokenizers against a plain version over whole texts."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loomfact.llm import alignment, queries

FOLDER = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  ", "\n", "a", "a b", " a", "a ", "a\n", "a\n\nb", "a  b", "a \n b\t\tc", "if (x) {\r\n\ty();\r\n}\r", "it's we'll 'S",
    "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", "▁", "a b", "a  b", "a　 \n x", "   b", "x y   z", "naïve café à la é", "日本語のテキスト。空白なし",
    "👍🏽👩‍👩‍👧 ok", "a\x00b \x1c c\x1f d", "é é", "1234567 12.5% $3", "x" * 5000, "ab " * 3000, "\t", "\r\n", " \n", "\n \n", "a\x85 b", "https://a.b/c?d=e&f=g",
]


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = alignment.byte_level()

    def tokens(text):
        if not text:
            return None
        whole = (" " + text).encode()
        x = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        return (x, y) if b"".join(t for _, t in x) == whole == b"".join(t for _, t in y) else None

    def groups(text):
        got = tokens(text)
        if got is None:
            return []
        ends = []
        for side in got:
            n, own = 0, []
            for _, raw in side:
                n += len(raw)
                own.append(n)
            ends.append(own)
        out, last = [], 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            out.append(tuple([i for (i, _), e in zip(side, own, strict=True) if last < e <= end] for side, own in zip(got, ends, strict=True)))
            last = end
        return out

    return groups


def brute(rows, groups):
    found = [(doc_id, groups(text)) for doc_id, text in rows]
    held, best = Counter(), defaultdict(int)
    for _, g in found:
        held.update({(x, y) for xs, ys in g for x in xs for y in ys})
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, g in found:
        links = [(x, y) for xs, ys in g for x in xs for y in ys]
        text = ";".join(f"{','.join(map(str, xs))}|{','.join(map(str, ys))}" for xs, ys in g)
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        out.append((doc_id, sum(len(xs) for xs, _ in g), sum(len(ys) for _, ys in g), len(g), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), digest))
    return Counter(out)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query_equals_brute_force(spark, plain):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = queries.op13_alignment(spark, FOLDER).select(*COLUMNS).collect()
    assert Counter(map(tuple, got)) == brute(rows, plain)


def test_odd_texts_alone_and_together(spark, plain):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (7, "a b"), (7, "a b"), (2**60 + 1, "a b")]
    docs = spark.createDataFrame([(*r, "x", [1]) for r in rows], "doc_id long, text string, links string, times array<int>").repartition(3)
    got = alignment.aligned(docs).select(*COLUMNS).collect()
    assert Counter(map(tuple, got)) == brute(rows, plain)
    assert alignment.aligned(docs.limit(0)).count() == 0


def test_joined_odd_texts(spark, plain):
    texts = [x + y for x in ODD[3:] for y in ODD[3:] if x and y and len(x) + len(y) < 60]
    rows = list(enumerate(texts))
    got = alignment.aligned(spark.createDataFrame(rows, "doc_id long, text string")).select(*COLUMNS).collect()
    assert Counter(map(tuple, got)) == brute(rows, plain)


def test_tables_start_again(plain, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(alignment, "TABLE_UNITS", 5)
    lib = alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    for text in ("one two three four five six", "seven eight nine ten", "one two"):
        got = lib.align(pa.array([text, "é x"])).iloc[0]
        want = plain(text)
        assert got.groups == ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in want)
