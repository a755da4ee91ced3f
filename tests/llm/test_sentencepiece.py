import odd
from fieldtrace.llm import sentencepiece_viterbi as sv


def brute(vocab, text):
    """Best score by trying all pieces at every place, longest last piece first."""
    import sentencepiece

    import public_tokenizers

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sv.MODEL))
    known = {library.id_to_piece(i): i for i in range(library.get_piece_size())
             if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))}
    if not text:
        return []
    text = "".join(sv.MARK if c == " " else "\0" if c == sv.MARK else c for c in " " + text)
    best = [(0.0, 0, [])] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 16), end):
            piece = text[start:end]
            if piece in known:
                score, ids = library.get_score(known[piece]), [known[piece]]
            elif end - start == 1:
                raw = (sv.MARK if piece == "\0" else piece).encode()
                score, ids = vocab.unknown, [int(vocab.byte_ids[b]) for b in raw]
            else:
                continue
            total = best[start][0] + score
            if best[end] is None or total > best[end][0]:
                best[end] = (total, start, ids)
    found, at = [], len(text)
    while at:
        found, at = best[at][2] + found, best[at][1]
    return found


def test_against_brute_force_and_back(spark):
    rows = [(i, t, s) for i, t, s in odd.texts() if t is None or len(t) < 6000 and "\x00" not in t]
    found = sv.encode(odd.frame(spark, rows), with_decoded=True)
    assert "Score" in found.columns and dict(found.dtypes)["ids"] == "array<int>"
    vocab = sv.vocabulary()
    for row in found.collect():
        assert row.ids == brute(vocab, row.text or "") and row.n_tokens == len(row.ids)
        assert row.decoded == (row.text or "")


def test_long_and_odd_texts_come_back(spark):
    back = sv.decode(sv.encode(odd.frame(spark)).drop("decoded"))
    assert all(r.decoded == (r.text or "") for r in back.collect())


def test_spellings_do_not_depend_on_their_group():
    vocab = sv.vocabulary()
    texts = [odd.prose(i, 50).encode() for i in range(20)]
    ids, counts = vocab.encode(texts)
    alone = [vocab.encode([t])[0].tolist() for t in texts]
    assert ids.tolist() == [x for a in alone for x in a] and counts.tolist() == [len(a) for a in alone]


def test_empty_and_null(spark):
    assert sv.encode(odd.empty(spark)).count() == 0
    rows = spark.createDataFrame([(1, None), (2, []), (3, [None, 1])], "k int, ids array<int>")
    assert [r.decoded for r in sv.decode(rows).orderBy("k").collect()] == ["", "", ""]
