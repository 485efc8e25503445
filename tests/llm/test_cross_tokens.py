"""Cross-tokenizer alignment against both libraries and plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from vigilframe.llm import cross_tokens as ct
from vigilframe.llm.queries import QUERIES

A, B = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [" ", "  ", "'s", "'LL", "1", "½", "é", "́", "中", "日本語", "😀", "‍", "️", "▁", "\n", "\r\n\n", "\t", "<|endoftext|>", "</s>", "<0x41>", "\x00", "naïve", "über", " the", "of,", "ﬁ", " ", "ß", "#!?"]


def plain(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, sha) of each text, by the libraries and loops over all bytes."""
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=B)
    signs = ct._byte_signs()
    found = []
    for text in texts:
        raw, groups, links = (" " + (text or "")).encode(), [], []
        a = [(i, bytes(signs[c] for c in one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()) for i in two.encode(text or "") for p in [two.id_to_piece(i)]] if text else []
        if not text or b"".join(t for _, t in a) != raw or b"".join(t for _, t in b) != raw:
            a, b = [], []
        at, ends = 0, {}
        for i, t in b:
            at += len(t)
            ends[at] = i
        at, mine, rest = 0, [], list(b)
        done = 0
        for i, t in a:
            at += len(t)
            mine.append(i)
            if at in ends:
                theirs = []
                while done < at:
                    theirs.append(rest[0][0])
                    done += len(rest.pop(0)[1])
                groups.append((mine, theirs))
                links.append((i, ends[at]))
                mine = []
        found.append((a, b, groups, links))
    counts = Counter(x for *_, links in found for x in links)
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for a, b, groups, links in found:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(shown.encode()).hexdigest() if a else ""))
    return out


def texts():
    r = random.Random(3)
    some = ["".join(r.choice(ODD) for _ in range(r.randint(1, 60))) for _ in range(60)]
    return [None, "", "a", " ", "▁", "x" * 3000, "😀" * 500, "The same text, twice.", "The same text, twice.", " ".join(r.choice(["the", "unbelievable", "Straße", "12345"]) for _ in range(4000)), *some]


def test_op12(spark, tmp_path):
    rows = list(enumerate(texts())) + [(None, "no id at all")]
    spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, links string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_cross_tokenizer"](spark, str(tmp_path)).collect()
    key = lambda x: (x[0] is None, x[0])
    found = sorted(((x.doc_id, x.n_a, x.n_b, x.n_groups, x.n_links, x.n_best, x.count_sum, x.groups_sha256) for x in got), key=key)
    assert found == sorted(((i, *p) for (i, _), p in zip(rows, plain([t for _, t in rows]), strict=True)), key=key)


def test_groups_and_empty(spark):
    docs = spark.createDataFrame([(1, "Ein unbelievable 日本"), (2, None)], "doc_id long, text string")
    got = {x.doc_id: x.groups for x in ct.aligned_groups(docs, A, B).collect()}
    pair = ct.tokenizer_pair(A, B)
    assert got[2] == [] and len(got[1]) > 2
    assert all(b"".join(pair.bytes_a[i] for i in g.a) == b"".join(pair.bytes_b[i] for i in g.b) for g in got[1])
    assert b"".join(pair.bytes_a[i] for g in got[1] for i in g.a) == " Ein unbelievable 日本".encode()
    assert ct.alignment_digests(docs.limit(0), A, B).collect() == []


def test_cuts_by_sets():
    r = np.random.default_rng(0)
    for share in (0.02, 0.3, 0.9):
        for _ in range(20):
            ends, lasts, base, all_a, all_b = [], [], 0, [], []
            for _ in range(5):
                n = int(r.integers(5, 400))
                a, b = (np.unique(np.append(np.flatnonzero(r.random(n) < p) + 1, n)) for p in (share, 0.5))
                all_a.append(a + base)
                all_b.append(b + base)
                base += n
                lasts.append(sum(map(len, all_a)) - 1)
            a, b = np.concatenate(all_a), np.concatenate(all_b)
            of_a, of_b = ct.shared_cuts(a, b, np.array(lasts))
            ends = sorted(set(a.tolist()) & set(b.tolist()))
            assert a[of_a].tolist() == b[of_b].tolist() == ends


@pytest.mark.parametrize("start", range(0, 0x30000, 0x8000))
def test_rank_encoder_is_the_library(start):
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    known = ct.tokenizer_pair(A, B).a
    texts = [f" a{chr(c)}b1{chr(c)}2 {chr(c)}  {chr(c)}" for c in range(start, start + 0x8000) if not 0xD800 <= c < 0xE000]
    assert [e.ids for e in one.encode_batch_fast(texts, add_special_tokens=False)] == [known.encode_ordinary(t) for t in texts]
