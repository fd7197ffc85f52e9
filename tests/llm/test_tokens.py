import hashlib
import random

import numpy as np
import pytest

public = pytest.importorskip("public_tokenizers")
ODD = ["", "  ", "it's we're they've I'll I'd 'sun 'rest 'velvet 'll 'l 'r ''s !'s a's's 'Re", "<|endoftext|>hello<|startoftext|> x<|endoftext|>", "ΑΣ ΣΑΣ. İstanbul", "日本語テキスト🙂🙃 mixed", "a" * 3000,
       "x1y22 ½ Ⅳ", "é ̈a", "'''r", "don't'", "a\x85b​c d", "<|endoftext", "  hello   wörld \n\t x  ", "a▁b", "▁▁x", "\x00\x01", "<s> </s>▁▁", "x" * 5000 + "ab" * 300, "é" * 400, "\U0001F600" * 300, "trail ", "\n\n\n"]


def fuzz(n=300):
    r = random.Random(8)
    alphabet = "abcdeERtsmlv 'éÉßΣñ12½.,!?-_\n\t▁日🙂<|>"
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(n)]


def test_counts_are_the_library_s():
    from tokenizers import Tokenizer

    from terrasift.llm.token_counts import Counter
    path = public.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), Counter(path)
    texts = ODD + fuzz()
    assert own.count(texts).tolist() == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_scanner_maps_compose():
    from terrasift.llm.token_counts import CHUNK, OUT, run_scanner, scanner
    to, out = scanner()
    cls = np.random.default_rng(1).integers(0, 9, 5 * CHUNK + 17).astype(np.uint8)
    state, want = OUT, []
    for c in cls:
        want.append(out[state, c])
        state = to[state, c]
    assert run_scanner(cls, to, out).tolist() == want


def test_ids_are_the_library_s_and_come_back():
    import sentencepiece

    from terrasift.llm.sentencepiece_codec import Codec
    path = public.path("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), Codec(path)
    for t in ODD + fuzz():
        ids = lib.encode(t, add_bos=True, add_eos=True)
        assert own.encode(t) == ids
        assert own.decode(ids) == lib.decode(ids)


def test_operators_on_odd_rows(spark):
    from terrasift.llm.sentencepiece_codec import encode_documents
    from terrasift.llm.token_counts import count_tokens
    df = spark.createDataFrame([(1, None, 5), (None, "", 6), (2, "a b", 7), (2, "a b", 7), (3, "word " * 20_000, 8)], "doc_id long, text string, n_tokens long")
    t = count_tokens(df, public.path("word_bpe_49k.json"))
    assert sorted(map(tuple, t.collect()), key=str) == sorted([(1, 0, 0, False), (None, 0, 0, False), (2, 3, 2, False), (2, 3, 2, False), (3, 100_000, 20_000, True)], key=str)
    e = encode_documents(df, public.path("piece_bpe_32k.model"), with_ids=True).collect()
    assert len(e) == 5
    for r in e:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
    assert {r.decoded_sha256 for r in e if r.doc_id == 2} == {hashlib.sha256(b"a b").hexdigest()}
    assert count_tokens(df.limit(0), public.path("word_bpe_49k.json")).count() == 0


def thue(n, a, b):
    s = a
    while len(s) < n:
        s += s.translate(str.maketrans(a + b, b + a))
    return s


def test_words_that_a_polynomial_hash_cannot_tell_apart():
    import sentencepiece
    from tokenizers import Tokenizer

    from terrasift.llm.sentencepiece_codec import Codec
    from terrasift.llm.token_counts import Counter
    texts = [thue(1024, "a", "b"), thue(1024, "b", "a")]
    texts.append(" ".join(texts))
    path = public.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    assert Counter(path).count(texts).tolist() == [len(lib.encode(t).ids) for t in texts]
    path = public.path("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), Codec(path)
    raw = [t.encode() for t in texts]
    ids, n = own.encode_part(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])))
    ends = np.cumsum(n)
    assert [ids[e - k : e].tolist() for e, k in zip(ends, n)] == lib.encode(texts)


def test_distinct_compares_words_and_not_hashes():
    from terrasift.llm.bpe import distinct
    words = [b"ab", b"ba", b"ab", b"abc", b"ba", b"c"]
    lens = np.array([len(w) for w in words])
    one, which = distinct(np.frombuffer(b"".join(words), np.uint8), np.cumsum(lens) - lens, lens, np.zeros(6, np.uint64))
    assert [words[one[i]] for i in which] == words and len(one) == 4


def test_word_machine_is_the_merge_queue_and_starts_over(monkeypatch):
    """Against merging one pair after another, with words longer than a chunk and a machine that forgets."""
    from terrasift.llm import word_machine
    r = random.Random(3)
    single = {s: i for i, s in enumerate([97, 98, 99, 256 + 97, 256 + 98, 256 + 99])}
    pieces, merges = {i: (s,) for s, i in single.items()}, {}
    while len(merges) < 60:
        a, b = r.choice(list(pieces)), r.choice(list(pieces))
        if pieces[a][-1] < 256 and (a, b) not in merges and len(pieces[a]) + len(pieces[b]) < 7 and pieces[a] + pieces[b] not in pieces.values():
            machine = word_machine.WordMachine(pieces, merges, single)
            if machine.beside(a, b):  # as training does: a pair that stands side by side
                merges[a, b] = (len(merges), len(pieces))
                pieces[len(pieces)] = pieces[a] + pieces[b]
    machine = word_machine.WordMachine(pieces, merges, single)
    monkeypatch.setattr(word_machine, "MOST", 50)
    for _ in range(3):
        words = ["".join(r.choice("abc") for _ in range(r.choice([1, 2, 5, 9, 300]))) for _ in range(80)]
        symbols = np.concatenate([np.array([*w[:-1].encode(), 256 + ord(w[-1])]) for w in words])
        ends = np.cumsum([len(w) for w in words])
        sums = np.append(0, np.cumsum(machine.count(symbols)))[ends]
        assert np.diff(np.append(0, sums)).tolist() == [len(machine.merged((*w[:-1].encode(), 256 + ord(w[-1])))) for w in words]
