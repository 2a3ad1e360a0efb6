"""Tables of inputs and outputs for normalizers, pre-tokenizers, decoders, post-processors and subword models."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import decode, normalize, post, pretokenize
from tessera.functions import text as t
from tessera.operators import subword, vocabularies
from tessera.plans.tokenizer import Tokenizer, TokenizerError, model_kind


def one(spark, expression, *values):
    """The expression over columns a, b, ... of one row."""
    names = "abcdef"[: len(values)]
    return spark.createDataFrame([values], ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'string'}" for n, v in zip(names, values, strict=True))).select(expression).head()[0]


@pytest.mark.parametrize(
    "config, text, expected",
    [
        ({"type": "Lowercase"}, "Café ÜBER", "café über"),
        ({"type": "NFD"}, "é", "é"),
        ({"type": "NFC"}, "é", "é"),
        ({"type": "NFKC"}, "ﬁ①", "fi1"),
        ({"type": "StripAccents"}, "é①", "é1"),
        ({"type": "BertNormalizer"}, "Héllo\r\nW中x\t!", "hello w 中 x !"),
        ({"type": "BertNormalizer", "lowercase": False}, "Héllo", "Héllo"),
        ({"type": "BertNormalizer", "strip_accents": False}, "HÉ", "hé"),
        ({"type": "BertNormalizer"}, "ガ", "カ"),
        ({"type": "Strip"}, "　 a b \x85\n", "a b"),
        ({"type": "Strip", "strip_left": False}, " a ", " a"),
        ({"type": "Strip", "strip_right": False}, " a ", "a "),
        ({"type": "Prepend", "prepend": "▁"}, "", "▁"),
        ({"type": "Replace", "pattern": {"String": "."}, "content": "!"}, "a.b.", "a!b!"),
        ({"type": "Replace", "pattern": {"Regex": "(a)(b)"}, "content": "$2$1"}, "abab", "baba"),
        ({"type": "Replace", "content": "x"}, "ab", "ab"),
        ({"type": "Precompiled"}, "a\x01b▁c～ﬁ～", "ab c～fi"),
        ({"type": "Sequence", "normalizers": [{"type": "Lowercase"}, {"type": "NFD"}]}, "É", "é"),
    ],
)
def test_normalizers(spark, config, text, expected):
    assert one(spark, normalize.normalize(F.col("a"), normalize.normalizer(config)), text) == expected


@pytest.mark.parametrize(
    "config, text, expected",
    [
        ({"type": "Whitespace"}, "a  b　c\nd", ["a", "b", "c", "d"]),
        ({"type": "WhitespaceSplit"}, "Hey, you!", ["Hey,", "you!"]),
        ({"type": "BertPreTokenizer"}, "Hey, my_friend!?", ["Hey", ",", "my", "_", "friend", "!", "?"]),
        ({"type": "Punctuation"}, "Hey, you?!", ["Hey", ",", " you", "?!"]),
        ({"type": "Digits"}, "1 and 234", ["1", " and ", "234"]),
        ({"type": "Digits", "individual_digits": True}, "a12", ["a", "1", "2"]),
        ({"type": "ByteLevel", "add_prefix_space": False}, "Hey  friend's é", ["Hey", "Ġ", "Ġfriend", "'s", "ĠÃ©"]),
        ({"type": "ByteLevel", "add_prefix_space": True}, "Hey there's", ["ĠHey", "Ġthere", "Ġ's"]),
        ({"type": "ByteLevel", "use_regex": False}, "a b", ["aĠb"]),
        ({"type": "Metaspace", "replacement": "▁"}, "Hey you  all", ["▁Hey", "▁you", "▁", "▁all"]),
        ({"type": "Metaspace", "replacement": "▁", "prepend_scheme": "never"}, "Hey you", ["Hey", "▁you"]),
        ({"type": "Metaspace", "replacement": "▁", "add_prefix_space": False}, "Hey", ["Hey"]),
        ({"type": "Metaspace", "replacement": "▁", "prepend_scheme": "strange"}, "", ["▁"]),
        ({"type": "Split", "pattern": {"String": " "}, "invert": True}, "a b", ["a", "b"]),
        ({"type": "Split", "pattern": {"String": " "}}, "a b", ["a", " ", "b"]),
        ({"type": "Split", "pattern": {"Regex": "\\d"}, "behavior": "Removed"}, "a1b", ["a", "1", "b"]),
        ({"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "Punctuation"}]}, "a, b", ["a", ",", "b"]),
    ],
)
def test_pretokenizers(spark, config, text, expected):
    assert one(spark, pretokenize.pretokenizer(config)(F.col("a"), F.lit(True)), text) == expected


def test_split_behaviours(spark):
    text = "the-final--countdown-"
    expected = {
        "removed": ["the", "final", "countdown"],
        "isolated": ["the", "-", "final", "-", "-", "countdown", "-"],
        "merged_with_previous": ["the-", "final-", "-", "countdown-"],
        "merged_with_next": ["the", "-final", "-", "-countdown", "-"],
    }
    for behaviour, pieces in expected.items():
        assert one(spark, pretokenize.split_behaviour(F.col("a"), "-", behaviour), text) == pieces
    with pytest.raises(ValueError):
        pretokenize.split_regex(F.col("a"), "x*")
    assert [tuple(r) for r in one(spark, pretokenize.ranges(F.col("a"), "-+"), text)] == [(3, 4), (9, 11), (20, 21)]


@pytest.mark.parametrize(
    "config, tokens, expected",
    [
        ({"type": "Metaspace", "replacement": "▁"}, ["▁Hey", "▁my", "▁friend"], ["Hey", " my", " friend"]),
        ({"type": "Metaspace", "replacement": "▁", "prepend_scheme": "never"}, ["▁Hey"], [" Hey"]),
        ({"type": "WordPiece", "prefix": "##", "cleanup": True}, ["##inter", "##national", "ization", ".", "n't"], ["##inter", "national", " ization", ".", "n't"]),
        ({"type": "WordPiece", "prefix": "##"}, [], []),
        ({"type": "ByteLevel"}, ["HeyĠ", "Ã©", "Ã"], ["Hey é�"]),
        ({"type": "ByteFallback"}, ["a", "<0xC3>", "<0xA9>", "b", "<0x41>"], ["a", "é", "b"]),
        ({"type": "ByteFallback", "flush_tail": True}, ["a", "<0x41>"], ["a", "A"]),
        ({"type": "Fuse"}, ["a", "b"], ["ab"]),
        ({"type": "Strip", "content": " ", "start": 1, "stop": 0}, ["  a "], [" a "]),
        ({"type": "Replace", "pattern": {"String": "▁"}, "content": " "}, ["▁a", "b▁"], [" a", "b "]),
        ({"type": "Sequence", "decoders": [{"type": "Fuse"}, {"type": "Strip", "content": " ", "start": 1, "stop": 0}]}, [" a", " b"], ["a b"]),
    ],
)
def test_decoders(spark, config, tokens, expected):
    assert one(spark, decode.decoder(config)(F.col("a")), tokens) == expected


def test_byte_level_decoder_keeps_added_tokens(spark):
    assert one(spark, decode.decoder({"type": "ByteLevel"}, ("<s>",))(F.col("a")), ["<s>", "aĠ", "b", "<s>"]) == ["<s>", "a b", "<s>"]
    with pytest.raises(Exception, match="alphabet"):
        one(spark, decode.byte_level(F.col("a")), ["中"])


def test_clean_up(spark):
    assert one(spark, decode.clean_up(F.col("a")), "it is n't so , he 's ' x ' .") == "it isn't so, he's'x '."


def test_postprocessors(spark):
    a, b = ["  x ", "y"], ["z"]
    cls = {"cls": ["<s>", 0], "sep": ["</s>", 2]}
    roberta = post.postprocessor({"type": "RobertaProcessing", **cls})
    assert one(spark, roberta(F.col("a"), F.col("b"), False), a, b) == ["<s>", " x ", "y", "</s>", "</s>", "z", "</s>"]
    odd = ["\u00a0\u3000x\u2003\u00a0", "\n\u00a0 y\n", "\u3000", "\u200bz\u200b"]
    assert one(spark, roberta(F.col("a"), None, True), odd, []) == ["<s>", "\u3000x\u2003", " y\n", "\u3000", "\u200bz\u200b", "</s>"]
    bare = post.postprocessor({"type": "RobertaProcessing", **cls, "add_prefix_space": False})
    assert one(spark, bare(F.col("a"), None, True), odd, []) == ["<s>", "x", "\n\u00a0 y\n", "", "\u200bz\u200b", "</s>"]
    assert one(spark, post.postprocessor({"type": "RobertaProcessing", "add_prefix_space": False, **cls})(F.col("a"), None, True), a) == ["<s>", "x", "y", "</s>"]
    bert = post.postprocessor({"type": "BertProcessing", **cls})
    assert one(spark, bert(F.col("a"), F.col("b"), True), a, b) == ["<s>", *a, "</s>", "z", "</s>"]
    assert one(spark, bert(F.col("a"), F.col("b"), False), a, b) == [*a, "z"]
    template = {"type": "TemplateProcessing", "single": [{"SpecialToken": {"id": "<s>"}}, {"Sequence": {"id": "A"}}], "pair": [{"Sequence": {"id": "A"}}, {"SpecialToken": {"id": "<s>"}}, {"Sequence": {"id": "B"}}]}
    assert one(spark, post.postprocessor(template)(F.col("a"), None, True), a) == ["<s>", *a]
    assert one(spark, post.postprocessor(template)(F.col("a"), F.col("b"), False), a, b) == [*a, "z"]


def test_byte_alphabet():
    assert len(set(t.BYTES)) == 256
    assert (t.BYTES[32], t.BYTES[10], t.BYTES[65], t.BYTES[255]) == ("Ġ", "Ċ", "A", "ÿ")


def test_trie():
    trie = subword.Trie(["cat", "carp", "car"])
    assert list(trie.prefixes("carpooling")) == ["car", "carp"]
    assert list(trie.prefixes("dog")) == []


def naive_bpe(model: subword.Bpe, piece: str) -> list[str]:
    parts = list(piece)
    while True:
        ranked = [(model.ranks[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in model.ranks]
        if not ranked:
            return parts
        _, i = min(ranked)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="thenrigodaĠ", max_size=30))
def test_bpe_equals_the_naive_one(piece):
    model = vocabularies.bpe()
    assert model.merge(piece) == naive_bpe(model, piece)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="thenrx▁q", min_size=1, max_size=9))
def test_unigram_equals_brute_force(piece):
    model = vocabularies.unigram()

    def best(at: int) -> float:
        if at == len(piece):
            return 0.0
        options = [float(model.scores[p]) + best(at + len(p)) for p in model.trie.prefixes(piece, at)]
        if piece[at] not in model.scores:
            options.append(float(model.unk_score) + best(at + 1))
        return max(options)

    found = model.tokens(piece)
    assert "".join(found) == piece
    assert sum(float(model.scores.get(p, model.unk_score)) for p in found) == pytest.approx(best(0))


def test_wordpiece():
    model = subword.WordPiece({"[UNK]": 0, "サ": 1, "##サ": 2})
    assert model.tokens("ササ") == ["サ", "##サ"]
    assert model.tokens("サx") == ["[UNK]"]
    assert model.tokens("サ" * 101) == ["[UNK]"]


def test_bpe_falls_back_to_bytes():
    model = subword.Bpe({"a": 0, "b": 1, "ab": 2}, ["a b"])
    assert model.tokens("abé") == ["ab", "<0xC3>", "<0xA9>"]


def test_tokenizer(spark):
    data = {
        "added_tokens": [{"id": 4, "content": "<s>", "special": True}, {"id": 5, "content": "<sep>", "special": True, "lstrip": True, "rstrip": True}],
        "pre_tokenizer": {"type": "ByteLevel"}, "decoder": {"type": "ByteLevel"},
        "model": {"type": "BPE", "vocab": {"a": 0, "b": 1, "ab": 2, "Ġ": 3}, "merges": ["a b"]},
        "post_processor": {"type": "TemplateProcessing", "single": [{"SpecialToken": {"id": "<s>"}}, {"Sequence": {"id": "A"}}], "pair": []},
    }
    tokenizer = Tokenizer.compile(data, {"tokenizer_class": "GPT2TokenizerFast", "bos_token": {"content": "<s>"}})
    assert one(spark, tokenizer.tokenize(F.col("a")), "ab <sep>  ba<s>") == ["ab", "<sep>", "b", "a", "<s>"]
    assert one(spark, tokenizer.encode(F.col("a")), "ab a") == [4, 2, 3, 0]
    assert one(spark, tokenizer.decode(tokenizer.encode(F.col("a")), True), "ab a") == "ab a"
    assert tokenizer.token_id("bos_token") == 4
    with pytest.raises(Exception, match="no id"):
        one(spark, tokenizer.encode(F.col("a")), "x")
    with pytest.raises(TokenizerError):
        model_kind("NoSuchTokenizer")
    assert model_kind("NoSuchTokenizer", strict=False) == "BPE"


def test_unknowns_fuse_within_sections(spark):
    data = {"added_tokens": [{"id": 9, "content": "<s>"}], "model": {"vocab": [["<unk>", 0.0], ["a", -1.0]], "unk_id": 0}}
    tokenizer = Tokenizer.compile(data, {"tokenizer_class": "T5Tokenizer"})
    assert one(spark, tokenizer.tokenize(F.col("a")), "xya<s>xy") == ["x", "a", "<s>", "x"]


def test_llama(spark):
    vocab = {"<unk>": 0, "<s>": 1, "▁": 2, "a": 3, "▁a": 4}
    data = {"added_tokens": [{"id": 1, "content": "<s>", "special": True}], "model": {"vocab": vocab, "merges": ["▁ a"], "unk_token": "<unk>"}}
    config = {"tokenizer_class": "LlamaTokenizer", "bos_token": "<s>", "legacy": False}
    tokenizer = Tokenizer.compile(data, config)
    assert one(spark, tokenizer.encode(F.col("a")), "a a") == [1, 4, 4]
    assert one(spark, tokenizer.tokenize(F.col("a")), "<s>a") == ["<s>", "a"]
    with pytest.raises(TokenizerError):
        Tokenizer.compile(data, {"tokenizer_class": "LlamaTokenizer"})


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=20).filter(lambda x: not any("" <= c <= "" for c in x)), min_size=1, max_size=5))
def test_round_trip(spark, texts):
    from tessera.queries import bpe_tokenizer

    tokenizer = bpe_tokenizer()
    df = spark.createDataFrame([(x,) for x in texts], "a string").select("a", tokenizer.decode(tokenizer.encode(F.col("a"))).alias("b"))
    assert all(r.a == r.b for r in df.collect())


@pytest.mark.parametrize(
    "lower, cjk, text, expected",
    [
        (True, True, "Héllo, wörld!\t[MASK] x[SEP]", ["hello", ",", "world", "!", "[MASK]", "x", "[", "sep", "]"]),
        (False, True, "Héllo [UNK]A中文b", ["Héllo", "[", "UNK", "]", "A", "中", "文", "b"]),
        (True, False, "a中文b\nc", ["a中文b\nc"]),
        (True, True, "ガ\u3000\u00a0 x", ["カ", "x"]),
        (True, True, " \t", []),
        (True, True, "", []),
    ],
)
def test_basic(spark, lower, cjk, text, expected):
    model = subword.Basic(lower, cjk)
    assert model.tokens(text) == expected
    assert one(spark, subword.tokenize(model)(pretokenize.blanks(F.col("a"))), text) == expected


def bert(vocab, **config):
    data = {"model": {"vocab": {x: i for i, x in enumerate(vocab)}}, "added_tokens": [{"id": 0, "content": "[UNK]", "special": True}]}
    return Tokenizer.compile(data, {"tokenizer_class": "BertTokenizer", **config})


def test_bert_without_pretokenizer(spark):
    vocab = ["[UNK]", "hello", "wor", "##ld", "中", "Hello", ","]
    assert one(spark, bert(vocab).tokenize(F.col("a")), "Hello WORLD,中 q [UNK] hello") == ["hello", "wor", "##ld", ",", "中", "[UNK]", "[UNK]", "hello"]
    assert one(spark, bert(vocab, do_lower_case=False).tokenize(F.col("a")), "Hello hello") == ["Hello", "hello"]
    assert one(spark, bert(vocab, handle_chinese_chars=False).tokenize(F.col("a")), "x中") == ["[UNK]"]
    assert one(spark, bert(vocab).tokenize(F.col("a")), None) is None


def test_longest_sequence(spark):
    tokenizer = bert(["[UNK]", "a"])
    assert one(spark, tokenizer.ids_within(F.col("a")), "a " * 512) == [1] * 512
    with pytest.raises(Exception, match="too_long: 513 ids"):
        one(spark, tokenizer.ids_within(F.col("a")), "a " * 513)
    assert one(spark, subword.too_long(tokenizer.encode(F.col("a")), 2), "a a a") is True


def test_tokenizer_of_a_folder(spark, tmp_path):
    (tmp_path / "tokenizer.json").write_text('{"model": {"vocab": {"[UNK]": 0, "a": 1}}}')
    with pytest.raises(TokenizerError, match="missing_config"):
        Tokenizer.from_folder(tmp_path)
    (tmp_path / "config.json").write_text('{"model_type": "bert"}')
    (tmp_path / "tokenizer_config.json").write_text('{"unk_token": "[UNK]"}')
    assert one(spark, Tokenizer.from_folder(tmp_path).encode(F.col("a")), "A b") == [1, 0]


def test_private_use_characters(spark):
    """Characters that serve as marks inside are characters like others in texts."""
    text = "a\ue000b \ue001c \ue002 \ue003\ue002d the \ue002"
    assert one(spark, pretokenize.split_string(F.col("a"), " ", True), text)[:3] == ["a\ue000b", " ", "\ue001c"]
    assert one(spark, pretokenize.split_regex(F.col("a"), "b"), text)[:2] == ["a\ue000", "b"]
    words = text.split()
    for added in ([], [{"id": 100, "content": "the"}]):
        vocab = {w: i for i, w in enumerate(["[UNK]", *dict.fromkeys(words)])}
        data = {"pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": added}
        made = Tokenizer.compile(data, {}, model=subword.WordPiece(vocab, "[UNK]", added={"the": vocab["the"]}))
        assert one(spark, made.tokenize(F.col("a")), text) == words
        assert one(spark, made.encode(F.col("a")), text) == [vocab[w] for w in words]
        assert one(spark, made.count(F.col("a")), text) == len(words)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abé中😀", min_size=1, max_size=5), min_size=1, max_size=20, unique=True), st.lists(st.text("abé中😀z\U0010ffff", max_size=260), max_size=8))
def test_unigram_side_by_side(entries, pieces):
    """Pieces of a batch together are the pieces alone; the flat trie is the plain one; long pieces among them."""
    model = subword.Unigram([("<unk>", 0.0), *((e, -(1 + i % 7) / 2) for i, e in enumerate(entries))], 0)
    assert model.many([*pieces, "ab" * 300]) == [tuple(model.tokens(p)) for p in [*pieces, "ab" * 300]]
    plain = subword.Trie(["<unk>", *entries])
    for p in pieces:
        assert list(model.trie.prefixes(p, len(p) // 2)) == list(plain.prefixes(p, len(p) // 2))


def test_white_space_beside_added_tokens(spark):
    data = {"added_tokens": [{"id": 2, "content": "<m>", "lstrip": True, "rstrip": True}], "model": {"type": "BPE", "vocab": {"a": 0, "b": 1, "​": 3}, "merges": []}}
    tokenizer = Tokenizer.compile(data, {"tokenizer_class": "GPT2Tokenizer"})
    assert one(spark, tokenizer.tokenize(F.col("a")), "a 　<m> \nb​<m>") == ["a", "<m>", "b", "​", "<m>"]


def test_remembered_pieces_are_bounded():
    kept = subword._Kept(subword.Bpe({"a": 0, "b": 1, "ab": 2}, ["a b"]))
    long = "ab" * 500
    assert kept.many(["ab", long, "ab"]) == [("ab",), ("ab",) * 500, ("ab",)] and list(kept.kept) == ["ab"]
    kept.size = subword.REMEMBERED
    assert kept.many(["ba"]) == [("b", "a")] and list(kept.kept) == ["ba"]


@pytest.mark.parametrize(
    ("text", "pattern", "pieces"),
    [
        ("a1b22c", r"(\d)+", ["a", "1", "b", "2", "c"]), ("a-b+c", "(-)|(\\+)", ["a", "-", "b", "+", "c"]), ("<x>y</x>", "<(/)?([a-z])>", ["x", "y", "x"]), ("  a ", r"\s+", ["  ", "a", " "]), ("abc", "x", ["abc"]), ("", "x", [""]),
        ("xaxb", "x(a)?", ["a", "x", "b"]),
    ],
)
def test_split_captures(spark, text, pattern, pieces):
    assert one(spark, pretokenize.split_captures(F.col("a"), pattern), text) == pieces
    with pytest.raises(ValueError):
        pretokenize.split_captures(F.col("a"), "x*")
