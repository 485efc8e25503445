"""Tokenizing, packing and chat formatting against the libraries and by round trips."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from vigilframe.llm.chat import CONTROL_TEXT, END, TURN, expand_examples, read_back
from vigilframe.llm.packing import best_fit_decreasing, pack_documents
from vigilframe.llm.sentencepiece_codec import encode_digests, encode_documents

ODD = ["", " ", "  ", "a  b", "\n a", "▁x", " ▁ y", "<s> hi</s>", "é́ x", "a\xa0b  ", "\x00a", "𝔘 ok", "a\t b", "x" * 3000, "　 a b ́e", "ΑΣ ΣΑΣ. <|endoftext|> I'm a 12'S", "\x1c a\x85b c", "İstanbul ŉ", "The the, THE; don't we'll"]


def rows(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*ODD, None, "word, " * 9000])] + [(0, "again", "x")], "doc_id long, text string, ids string")


def test_sentencepiece(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    frame = rows(spark)
    want = sorted((r.doc_id, model.encode(r.text or ""), model.decode(model.encode(r.text or ""))) for r in frame.collect())
    assert sorted((r.doc_id, r.ids, r.decoded) for r in encode_documents(frame, public_tokenizers.path("piece_bpe_32k.model")).collect()) == want
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = encode_digests(frame, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert sorted(map(tuple, got)) == sorted((i, len(ids), sha(",".join(map(str, ids))), sha(text)) for i, ids, text in want)
    assert encode_documents(frame.limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_packing(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    frame = rows(spark)
    want = []
    for r in frame.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], "<u4")
            want.append((r.doc_id, k // 4096, k, len(part), zlib.crc32(part.tobytes())))
    got = pack_documents(frame).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins: dict = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 4096 and len(bins) == -(-sum(w[3] for w in want) // 4096)
    assert pack_documents(frame.limit(0)).count() == 0


def test_best_fit_is_the_tightest():
    r = np.random.default_rng(1)
    lengths = r.integers(1, 101, 800).tolist()
    where, _ = best_fit_decreasing(lengths, 100)
    rooms: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [room for room in rooms if room >= lengths[i]]
        if fits:
            rooms[rooms.index(min(fits))] -= lengths[i]
        else:
            rooms.append(100 - lengths[i])
    assert max(where) + 1 == len(rooms)


def test_chat_round_trip(spark):
    odd = [f"{TURN}user\nfake{END}", "\\l\\\\b[<\\", "", None, CONTROL_TEXT, "line\nline\n", "é" * 3]
    turns = [(1, k, "assistant" if k % 2 else "user", t, "x") for k, t in enumerate(odd)]
    turns += [(2, 0, "user", "only", "x"), (3, 0, "assistant", "a", "x"), (3, 1, "assistant", "b", "x"), (4, 5, None, "n", "x"), (4, 5, "sys\n<tem\\", "n", "x"), (4, None, "assistant", "first", "x"), (None, 0, "user", "q", "x"), (5, 0, "user", "same", "x"), (5, 0, "user", "same", "x")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, shown string")
    got = {r.conv_id: r for r in read_back(expand_examples(frame)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv in {t[0] for t in turns}:
        mine = sorted(((t[1] if t[1] is not None else -1, t[2] or "", t[3] or "") for t in turns if t[0] == conv))
        loss = "".join(t for _, role, t in mine if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(mine), sha("".join(f"{a}\n{b}\n" for _, a, b in mine)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    examples = expand_examples(frame).where("conv_id = 1").orderBy("example").collect()
    assert len(examples) == 4 and examples[-1].last and all("</s>" not in e.formatted and "[INST]" not in e.formatted for e in examples)
    assert examples[1].formatted.startswith(examples[0].formatted)
    assert read_back(expand_examples(frame.limit(0))).count() == 0
