import copy
import hashlib
import random
import struct
import tracemalloc

import public_tokenizers
import sentencepiece

from tests.llm.cases import odd_documents, write_tables
from vespertide.llm.pieces import CharacterMap, PieceModel, decode_pieces, digest_rows, encode_pieces, load_pieces, op5_sentencepiece

PATH = public_tokenizers.path("piece_bpe_32k.model")


def expected(library, text):
    ids = library.encode(text, add_eos=True)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))


def test_digests_equal_those_of_the_library(spark, sf_dir):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op5_sentencepiece(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == expected(library, texts[r["doc_id"]] or "")


def test_odd_texts(spark, tmp_path):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    odd = ["  two  spaces ", "▁x ▁", "tab\tand\r\nline", "</s> <s> <unk> <0x41>", "\x00\x01", "ﬁ ½ ①"]
    docs = odd_documents(spark, odd)
    got = digest_rows(docs, PATH).collect()
    want = sorted(expected(library, r["text"] or "") for r in docs.collect())
    assert sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert op5_sentencepiece(spark, write_tables(tmp_path / "a", documents=docs.limit(0))).count() == 0


def test_spans_cover_the_bytes_and_decode_back(spark):
    docs = odd_documents(spark, ["Déjà vu, 日本 😀!"])
    for r in encode_pieces(docs.drop("pieces"), PATH).select("text", "pieces").collect():
        data = (r["text"] or "").encode()
        spans = [(p["begin"], p["end"]) for p in r["pieces"]]
        assert all(a <= b for a, b in spans) and spans == sorted(spans)
        assert not data or (spans[0][0] == 0 and spans[-1][1] == len(data))
    plain = encode_pieces(docs.select("text"), PATH).selectExpr("text", "transform(pieces, p -> p.id) AS ids")
    assert all(r["decoded"] == (r["text"] or "") for r in decode_pieces(plain, PATH).collect())


def compiled(entries):
    """A compiled character map of these replacements: each node's children lie at its offset, changed by their byte."""
    strings, at = b"", {}
    for key, to in entries.items():
        at[key.encode()] = len(strings)
        strings += to.encode() + b"\0"
    units, used = {0: 0}, {0}

    def place(node, prefix):
        depth = len(prefix)
        labels = sorted({k[depth] for k in at if k.startswith(prefix) and len(k) > depth} | ({0} if prefix in at else set()))
        if not labels:
            return
        base = next(b for b in range(1, 1 << 20) if all(node ^ b ^ c not in used for c in labels))
        units[node] |= base << 10 | (256 if prefix in at else 0)
        used.update(node ^ base ^ c for c in labels)
        for c in labels:
            child = node ^ base ^ c
            if c == 0:
                units[child] = at[prefix] | 1 << 31
            else:
                units[child] = c
        for c in labels:
            if c:
                place(node ^ base ^ c, prefix + bytes((c,)))

    place(0, b"")
    size = max(units) + 256
    data = b"".join(struct.pack("<I", units.get(i, 0x1FF if i else 0)) for i in range(size))
    return struct.pack("<I", len(data)) + data + strings


ENTRIES = {"ﬁ": "fi", "ﬁx": "FIX", "½": "1/2", "\t": " ", "\u3000": " ", "é": "e", "e\u0301": "é", "\u00ad": "", "ab": "x", "abcd": "yz"}


def plain_normalise(text, entries, prefix, squeeze):
    """(character, original begin) by trying every prefix; white space is squeezed at the ends and inside."""
    out, i = [], 0
    while i < len(text):
        n = max((len(k) for k in entries if text.startswith(k, i)), default=0)
        to = entries[text[i : i + n]] if n else text[i]
        out.append((to, len(text[:i].encode())))
        i += n or 1
    end = len(text.encode())
    while squeeze and out and out[0][0] == " ":
        out.pop(0)
    if not out:
        return "", [end]
    flat = [(" ", out[0][1])] * prefix
    # White space after a space goes, but the prefix is no space yet.
    last = " " if squeeze else ""
    for to, at in out:
        for c in to:
            if not (squeeze and c == " " and last == " "):
                flat.append((c, at))
            last = c
    while squeeze and flat and flat[-1][0] == " ":
        end = flat.pop()[1]
    return "".join(c for c, _ in flat).replace(" ", "▁"), [at for c, at in flat for _ in c.replace(" ", "▁").encode()] + [end]


def test_longest_prefix_in_a_character_map():
    trie = CharacterMap(compiled(ENTRIES))
    assert CharacterMap(b"").longest(b"abc", 0) is None
    for text, want in (("ﬁx", (4, b"FIX")), ("ﬁ!", (3, b"fi")), ("abc", (2, b"x")), ("abcde", (4, b"yz")), ("q", None), ("\u00ad", (2, b"")), ("a", None)):
        assert trie.longest(text.encode(), 0) == want


def test_alignment_matches_brute_force():
    rng = random.Random(8)
    for entries in ({}, ENTRIES):
        for prefix, squeeze in ((True, True), (True, False), (False, True), (False, False)):
            model = copy.copy(load_pieces(PATH))
            model.map, model.dummy_prefix, model.squeeze = CharacterMap(compiled(entries) if entries else b""), prefix, squeeze
            for _ in range(150):
                text = "".join(rng.choice(["ﬁ", "x", "½", "\t", "\u3000", "é", "e", "\u0301", "\u00ad", "ab", "cd", " ", "  ", "日", "😀"]) for _ in range(rng.randint(0, 14)))
                got, align = model.normalise(text.encode())
                want, places = plain_normalise(text, entries, prefix, squeeze)
                assert got.decode() == want, text
                if want:
                    assert align.tolist() == places, text


def test_spans_project_to_original_bytes():
    model = copy.copy(load_pieces(PATH))
    model.map = CharacterMap(compiled(ENTRIES))
    text = "a ﬁx ½ caf\u00e9 \u4e00\U0001f600"
    data = text.encode()
    for i, begin, end in model.encode_with_spans(text):
        assert 0 <= begin <= end <= len(data)
    n, ids, decoded, inside, spans = model.digest(text)
    assert inside == len(data) and len(spans) == 8 * (n - 1) and "FIX 1/2 cafe" in decoded


def test_digests_carry_the_spans(spark):
    model = load_pieces(PATH)
    docs = odd_documents(spark, ["Déjà vu, 日本 😀!"])
    texts = sorted((r["text"] or "") for r in docs.collect())
    got = sorted((r["n_covered"], r["spans_sha256"]) for r in digest_rows(docs, PATH).collect())
    want = []
    for t in texts:
        spans = model.encode_with_spans(t)
        want.append((len(t.encode()), hashlib.sha256(b"".join(struct.pack("<ii", b, e) for _, b, e in spans)).hexdigest()))
    assert got == sorted(want)


def test_chunks_of_many_texts_are_merged_together(monkeypatch):
    rng = random.Random(4)
    model = PieceModel(open(PATH, "rb").read())
    texts = ["".join(rng.choice("abdehinorstééß日▁  \n.0😀") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", "o" * 33, "e" * 500, "schiff " * 40]
    chunks = {c for t in texts for c in model.chunks.findall(model.normalise(t.encode())[0].decode())}
    model.learn(chunks)
    # Only long chunks and those with a character that is no piece are left to the walk over one chunk.
    assert {c for c in chunks if c not in model.memo} == {c for c in chunks if len(c) > 32 or any(x not in model.ids for x in c)}
    assert all(model.memo[c] == model._encode_chunk(c) for c in chunks)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    monkeypatch.setattr("vespertide.llm.pieces.GROUP_CHARACTERS", 50)
    for t, (_, ids, decoded, _, _) in zip(texts, PieceModel(open(PATH, "rb").read()).digests(texts), strict=True):
        want = library.encode(t, add_eos=True)
        assert (ids, decoded) == (" ".join(map(str, want)), library.decode(want))


def test_merging_many_chunks_takes_bounded_memory():
    model = PieceModel(open(PATH, "rb").read())
    rng = random.Random(4)
    chunks = {"▁" + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 25))) for _ in range(40_000)}
    tracemalloc.start()
    try:
        model.learn(chunks)
        kept, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    # All 40,000 at once took about 2 KB each.
    assert peak - kept < 40e6
    assert all(model.memo[c] == model._encode_chunk(c) for c in rng.sample(sorted(chunks), 300))
