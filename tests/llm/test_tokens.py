import random

from driftline.llm.tokens import LongestMatch, automaton, token_counts

DOCS = "doc_id long, text string, n_words string"


def greedy(word, starts, continuations):
    count, at, pieces = 0, 0, starts
    while at < len(word):
        size = max((n for n in range(1, len(word) - at + 1) if word[at:at + n] in pieces), default=0)
        if not size:
            return 0
        count, at, pieces = count + 1, at + size, continuations
    return count


def test_counts_equal_greedy_longest_match():
    rng = random.Random(9)
    for _ in range(150):
        piece = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
        starts = {piece() for _ in range(rng.randint(0, 8))}
        inside = {piece() for _ in range(rng.randint(0, 8))}
        machine = LongestMatch(starts, inside)
        for _ in range(120):
            word = "".join(rng.choice("abcd" if rng.random() < .1 else "abc")
                           for _ in range(rng.randint(1, 14)))
            assert machine.count(word) == greedy(word, starts, inside), (word, starts, inside)


def test_whole_table_counts_with_the_public_vocabulary(spark):
    texts = [None, "", "The quick  brown\nfox", "naïve été \U0001F600", "x" * 300_000,
             "repeat repeat", "repeat repeat"]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)] + [
        (None, "a", "b")], DOCS)
    rows = token_counts(docs).collect()
    machine = automaton("/opt/tokenizers/piece_bpe_32k.model")
    for row, text in zip(rows, [*texts, "a"]):
        counts = [machine.count(w) for w in (text or "").split()]
        assert row.n_words == len(counts)
        assert row.n_tokens == sum(c or 1 for c in counts)
        assert row.n_unknown == sum(c == 0 for c in counts)
    assert token_counts(docs.limit(0)).count() == 0


def test_no_vocabulary_makes_every_word_unknown(spark):
    docs = spark.createDataFrame([(1, "a b", None)], DOCS)
    row = token_counts(docs, build=lambda path: LongestMatch([], [])).first()
    assert (row.n_words, row.n_tokens, row.n_unknown) == (2, 2, 2)


def test_whole_vocabulary_on_digits_and_scripts_without_marked_pieces(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(
        model_file="/opt/tokenizers/piece_bpe_32k.model")
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (
        model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    longest = max(map(len, pieces))

    def plain(word):
        word, count, at = "▁" + word, 0, 0
        while at < len(word):
            size = max((n for n in range(1, longest + 1) if word[at:at + n] in pieces), default=0)
            count += 1 if size else len(word[at].encode())
            at += size or 1
        return count

    rng = random.Random(5)
    texts = ["2024 4111111111111111 3.14", "中文" * 500, "日本語のテキスト 한국어 ไทย हिन्दी", "Ελλάδα שלום привет",
             "hello\U0001F600world naïve\U00020000", "a▁b ▁▁ ▁", "͸", "x中1é͸▁y"]
    texts += [" ".join("".join(rng.choice("ab▁1中文字é͸\U0001F600the") for _ in range(
        rng.randint(1, 12))) for _ in range(20)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], DOCS)
    for row, text in zip(token_counts(docs).sort("doc_id").collect(), texts):
        assert (row.n_tokens, row.n_unknown) == (sum(map(plain, text.split())), 0), text
    assert token_counts(docs).where("doc_id = 1").first().n_tokens == 1001
