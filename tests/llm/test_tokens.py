from matchgrid.llm import tokens

SCORES = tokens.unigram_scores(tokens.public_tokenizers.path(tokens.VOCABULARY))


def _brute(word):
    full = tokens.MARK + word
    floor = min(SCORES.values()) + tokens.UNKNOWN_PENALTY
    best = [(0.0, 0)]
    for end in range(1, len(full) + 1):
        options = [(best[end - 1][0] + floor, best[end - 1][1] - len(full[end - 1].encode()))]
        options += [(best[s][0] + SCORES[full[s:end]], best[s][1] - 1) for s in range(end) if full[s:end] in SCORES]
        best.append(max(options))
    return -best[-1][1]


def test_counts_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in tokens.count_tokens(docs).collect()}
    memo = {}
    for r in docs.collect():
        words = r["text"].split()
        assert got[r["doc_id"]]["n_pretokens"] == len(words) and got[r["doc_id"]]["n_distinct"] == len(set(words))
        assert got[r["doc_id"]]["n_tokens"] == sum(memo.setdefault(w, _brute(w)) for w in words)


def test_prefixes_are_scored_once():
    counter = tokens.PrefixCounter(SCORES)
    words = ["interest", "interesting", "interested", "inter", "日本", "🙂x"]
    assert counter.count(words) == {w: _brute(w) for w in words}
    prefixes = {(tokens.MARK + w)[:i] for w in words for i in range(1, len(w) + 2)}
    assert counter.nodes == len(prefixes)


def test_states_stay_from_batch_to_batch_and_within_bounds(monkeypatch):
    counter = tokens.PrefixCounter(SCORES)
    counter.count(["interest"])
    before = counter.nodes
    assert counter.count(["interested"]) == {"interested": _brute("interested")} and counter.nodes == before + 2
    monkeypatch.setattr(tokens, "TRIE_NODES", 5)
    assert counter.count(["interest"]) == {"interest": _brute("interest")} and len(counter.score) == 10


def test_long_words_and_texts(spark):
    words = ["ab" * 40, "x" * 5000, "interesting" * 300, "日本" * 200]
    text = " ".join(words * 200)
    got = tokens.count_tokens(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string"), keep=["doc_id"]).collect()
    want = (800, 4, 200 * sum(map(_brute, words)))
    assert [tuple(r)[1:] for r in got] == [want, want]


def test_nulls_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, " \n", 5), (4, "a a b", 5)], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: (r["n_tokens"], r["n_pretokens"], r["n_distinct"]) for r in tokens.count_tokens(docs).collect()}
    assert got == {1: (5, 0, 0), 2: (5, 0, 0), 3: (5, 0, 0), 4: (5, 3, 2)}
    assert tokens.count_tokens(docs.limit(0)).count() == 0


def test_equal_scores_take_fewer_tokens():
    counter = tokens.PrefixCounter({"▁": -1.0, "a": -1.0, "b": -1.0, "ab": -2.0, "▁ab": -3.0})
    assert counter.count(["ab", "a", "abab"]) == {"ab": 1, "a": 2, "abab": 2}


def test_one_batch_of_new_words_stays_within_bounds(monkeypatch):
    monkeypatch.setattr(tokens, "TRIE_NODES", 300)
    monkeypatch.setattr(tokens, "SLICE", 10)
    counter = tokens.PrefixCounter(SCORES)
    most, insert = [0], counter._insert

    def watched(word):
        most[0] = max(most[0], len(counter.score))
        return insert(word)

    counter._insert = watched
    words = [f"w{i:05}" for i in range(400)]
    assert counter.count(words) == {w: _brute(w) for w in words} and most[0] < 300 + 10 * 8


def test_only_ends_of_pieces_are_looked_up():
    """What ends no piece ends the search of a prefix's last pieces, with the same counts."""
    counter = tokens.PrefixCounter(SCORES)
    looked = []

    class Watched(dict):
        def __contains__(self, piece):
            looked.append(piece)
            return super().__contains__(piece)

    counter.ends = Watched(counter.ends)
    words = ["zqxjzqxjzqxjzqxj", "interesting", "qqqq日本qqqq", "🙂"]
    assert counter.count(words) == {w: _brute(w) for w in words}
    pairs = sum(len(w) * (len(w) + 3) // 2 + 1 for w in words)
    assert counter.nodes <= len(looked) < pairs / 2
