"""Packing: every id in one piece, sequences gapless, little padding; plans against exhaustive subset sums."""
import random
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from cohortwave.llm.packing import best_fill, encoder, op3_packing, pack, plan


def test_best_fill_is_the_best_subset_sum():
    rng = random.Random(2)
    for _ in range(300):
        count = Counter({rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(0, 5))})
        room = rng.randint(0, 60)
        got = best_fill(count, room)
        assert all(got[n] <= count[n] for n in got)
        sums = [sum(n * c for n, c in zip(count, cs)) for cs in product(*(range(c + 1) for c in count.values()))]
        assert sum(n * c for n, c in got.items()) == max(s for s in sums if s <= room)


def test_plan_places_every_tail_once():
    rng = random.Random(3)
    for case in range(12):
        counts = {700: 5000} if not case else {rng.randint(1, 1023): rng.randint(1, 300) for _ in range(rng.choice([1, 3, 40, 400]))}
        rules, sequences = plan(counts)
        cover, seqs = defaultdict(list), defaultdict(list)
        for length, lo, hi, start, size, seq, per, j0, off in rules:
            for r in range(lo, hi):
                j = j0 + r - lo
                cover[length, r].append((start, size))
                seqs[seq + j // per].append((off + j % per * size, size))
        assert set(cover) == {(n, r) for n, c in counts.items() for r in range(c)} and set(seqs) == set(range(sequences))
        for (n, _), pieces in cover.items():
            at = 0
            for s, m in sorted(pieces):
                assert s == at and m > 0
                at += m
            assert at == n
        for pieces in seqs.values():
            at = 0
            for s, m in sorted(pieces):
                assert s == at
                at += m
            assert at <= 1024
        total = sum(n * c for n, c in counts.items())
        assert sequences == -(-total // 1024)


def check(rows, texts, capacity=1024):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for d, t in texts}
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length))
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start:r.start + r.length], "<u4").tobytes())
    for d, own in ids.items():
        copies = sum(x == d for x, _ in texts)
        assert sum(m for _, m in docs[d]) == copies * len(own)
        assert Counter(i for s, m in docs[d] for i in range(s, s + m)) == Counter(range(len(own))) if copies == 1 else True
    for pieces in seqs.values():
        at = 0
        for s, m in sorted(pieces):
            assert s == at
            at += m
        assert at <= capacity
    assert len(seqs) <= sum(map(len, (ids[d] for d, _ in texts))) // capacity + 2


def test_pack(spark, tmp_path):
    rng = random.Random(4)
    vocab = ["the", "and", "ñandú", "日本語", "x<|endoftext|>y", "1234", "\n\n", "it's", "<|not|>"]
    texts = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 5, 50, 400, 3000])))) for i in range(150)] + [(900, None), (901, ""), (902, "a"), (902, "a")]
    df = spark.createDataFrame([(d, t, "z") for d, t in texts], "doc_id long, text string, len string").repartition(6)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    check(op3_packing(spark, str(tmp_path)).collect(), texts)
    assert pack(df.limit(0)).count() == 0


def test_ids_are_those_of_the_tokenizer_library():
    tok, fast = Tokenizer.from_file(P.path("byte_bpe_50k.json")), encoder()
    for t in ["Hello  world's\n\n 'S 123 ½ ²x é ‍ 　 \t x", "I'LL it'll", "<|endoftext|> <| x", "\x00\x1c\x85", "😀👍🏽 नमस्ते"]:
        assert fast(t) == tok.encode(t, add_special_tokens=False).ids
