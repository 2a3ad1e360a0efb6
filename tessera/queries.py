"""Queries over the tables of a folder, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import oracle
from tessera.functions import decode, normalize, post, pretokenize
from tessera.functions import text as t
from tessera.functions import variants
from tessera.operators import generate, logits, subword, tables, vocabularies
from tessera.plans import chat
from tessera.plans.tokenizer import Tokenizer
from tessera.sources import files
from tessera.streaming import progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = dict(oracle.SQL)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The columns that costly functions of texts need, on all cores."""
    return files.spread(_read(spark, sf_dir, name).select(*columns))


def _pieces(df: DataFrame, key: str, pieces, name: str = "piece") -> DataFrame:
    return df.select(key, F.posexplode(pieces).alias("pos", name)).withColumn("pos", F.col("pos").cast("long"))


# Pre-tokenizers: (doc_id, pos, piece)

_PRE = {
    "pre_whitespace": pretokenize.whitespace,
    "pre_bert": pretokenize.bert,
    "pre_punctuation": pretokenize.punctuation,
    "pre_digits": pretokenize.digits,
    "pre_digits_individual": lambda c: pretokenize.digits(c, True),
    "pre_bytelevel": pretokenize.byte_level,
    "pre_bytelevel_prefix": lambda c: pretokenize.byte_level(c, prefix=True),
    "pre_bytelevel_noregex": lambda c: pretokenize.byte_level(c, regex=False),
    "pre_metaspace": lambda c: pretokenize.metaspace(c, F.lit(True)),
    "pre_split_string": lambda c: pretokenize.split_string(c, ". ", True),
    "pre_split_regex": lambda c: pretokenize.split_regex(c, "[0-9]+"),
    "pre_sequence": lambda c: pretokenize.pretokenizer({"type": "Sequence", "pretokenizers": [{"type": "Whitespace"}, {"type": "Digits", "individual_digits": True}]})(c, F.lit(True)),
}
for _name, _f in _PRE.items():
    QUERIES[_name] = lambda spark, d, f=_f: _pieces(_texts(spark, d, "documents", "doc_id", "text"), "doc_id", f(F.col("text")))

for _name in ("removed", "isolated", "merged_with_previous", "merged_with_next"):
    QUERIES[f"split_{_name}"] = lambda spark, d, b=_name: _pieces(_read(spark, d, "pages"), "page_id", pretokenize.split_behaviour(F.col("url"), "/", b))


QUERIES["split_captures"] = lambda spark, d: _pieces(_read(spark, d, "pages"), "page_id", pretokenize.split_captures(F.col("url"), "(:)//|[/?]([a-z]+)[=/]|[#&]"))


# Normalizers: (doc_id, text)

_NORM = {
    "norm_lowercase": {"type": "Lowercase"},
    "norm_prepend": {"type": "Prepend", "prepend": "▁"},
    "norm_replace_literal": {"type": "Replace", "pattern": {"String": " "}, "content": "▁"},
    "norm_replace_regex": {"type": "Replace", "pattern": {"Regex": "[0-9]+"}, "content": "0"},
    "norm_strip": {"type": "Strip"},
    "norm_bert": {"type": "BertNormalizer"},
    "norm_bert_cased": {"type": "BertNormalizer", "lowercase": False},
    "norm_nfc": {"type": "NFC"},
    "norm_nfd": {"type": "NFD"},
    "norm_nfkc": {"type": "NFKC"},
    "norm_nfkd": {"type": "NFKD"},
    "norm_strip_accents": {"type": "StripAccents"},
    "norm_precompiled": {"type": "Precompiled"},
    "norm_sequence": {"type": "Sequence", "normalizers": [{"type": "Lowercase"}, {"type": "Replace", "pattern": {"String": "."}, "content": " ."}, {"type": "Prepend", "prepend": ">"}]},
}
for _name, _c in _NORM.items():
    QUERIES[_name] = lambda spark, d, c=_c: _texts(spark, d, "documents", "doc_id", "text").select("doc_id", normalize.normalize(F.col("text"), normalize.normalizer(c)).alias("text"))


# Subword models on distinct words: (word, pos, token)


def _words(spark: SparkSession, d: str) -> DataFrame:
    words = pretokenize.whitespace(F.lower("text"))
    return _texts(spark, d, "documents", "text").select(F.explode(words).alias("word")).distinct()


def _model(model: subword.Model, pieces=lambda w: F.array(w)) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _pieces(_words(spark, d), "word", subword.tokenize(model)(pieces(F.col("word"))), "token")


QUERIES["bpe_merge"] = _model(vocabularies.bpe(), lambda w: F.array(t.to_bytes(w)))
QUERIES["wp_wordpiece"] = _model(vocabularies.wordpiece())
QUERIES["uni_tokenize"] = _model(vocabularies.unigram())


@query
def bpe_byte_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(_words(spark, sf_dir), "word", pretokenize.byte_level(F.col("word")), "token")


@query
def bpe_hexa_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(_words(spark, sf_dir), "word", pretokenize.hexa(F.col("word")), "token")


# Whole pipelines: (doc_id, n_tokens, ids)


def bpe_tokenizer() -> Tokenizer:
    return Tokenizer.compile({"pre_tokenizer": {"type": "ByteLevel"}, "decoder": {"type": "ByteLevel"}}, {"clean_up_tokenization_spaces": False}, model=vocabularies.bpe())


def wordpiece_tokenizer() -> Tokenizer:
    data = {
        "normalizer": {"type": "Lowercase"}, "pre_tokenizer": {"type": "BertPreTokenizer"}, "decoder": {"type": "WordPiece", "prefix": "##"},
        "post_processor": {"type": "BertProcessing", "cls": ["[CLS]", 2], "sep": ["[SEP]", 3]},
        "added_tokens": [{"id": i, "content": x, "special": True} for i, x in enumerate(vocabularies.SPECIAL)],
    }
    return Tokenizer.compile(data, {}, model=vocabularies.wordpiece())


def unigram_tokenizer() -> Tokenizer:
    data = {"normalizer": {"type": "Lowercase"}, "pre_tokenizer": {"type": "Metaspace", "replacement": t.UNDERLINE}, "decoder": {"type": "Metaspace", "replacement": t.UNDERLINE}}
    return Tokenizer.compile(data, {"clean_up_tokenization_spaces": False}, model=vocabularies.unigram())


_TOKENIZERS = {"bpe": bpe_tokenizer, "wp": wordpiece_tokenizer, "uni": unigram_tokenizer}


def _encoded(spark: SparkSession, d: str, make: Callable[[], Tokenizer]) -> DataFrame:
    return _texts(spark, d, "documents", "doc_id", "text").select("doc_id", make().encode(F.col("text")).alias("ids"))


for _name, _make in _TOKENIZERS.items():
    QUERIES[f"{_name}_encode"] = lambda spark, d, m=_make: _encoded(spark, d, m).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query
def tokens_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark, sf_dir, "documents", "lang", "text").select("lang", bpe_tokenizer().count(F.col("text")).alias("n"))
    return rows.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"), F.max("n").alias("longest"))


# Decoders on encoded documents: (doc_id, text)


@query
def decode_bytelevel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded(spark, sf_dir, bpe_tokenizer).select("doc_id", bpe_tokenizer().decode(F.col("ids")).alias("text"))


def _split(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, "documents", "doc_id", "text").select("doc_id", pretokenize.whitespace(F.col("text")).alias("ts"))


_DECODE = {
    "decode_wordpiece": lambda c: decode.wordpiece(c, "th"),
    "decode_metaspace": lambda c: decode.metaspace(F.transform(c, lambda x: F.concat(F.lit("▁"), x)), "▁"),
    "decode_strip": lambda c: decode.strip(F.transform(c, lambda x: F.concat(F.lit("  "), x, F.lit(" "))), 1, 1),
    "decode_replace": lambda c: decode.replace(c, " ", literal="e"),
    "decode_fuse": decode.fuse,
    "decode_byte_fallback": lambda c: decode.byte_fallback(F.flatten(F.transform(c, lambda x: F.when(x.startswith("t"), pretokenize.hexa(x)).otherwise(F.array(x))))),
    "decode_sequence": lambda c: decode.decoder({"type": "Sequence", "decoders": [{"type": "Replace", "pattern": {"String": "a"}, "content": "_"}, {"type": "Fuse"}]})(c),
}
for _name, _f in _DECODE.items():
    QUERIES[_name] = lambda spark, d, f=_f: _split(spark, d).select("doc_id", F.array_join(f(F.col("ts")), "").alias("text"))


@query
def wp_untokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = subword.tokenize(vocabularies.wordpiece())(pretokenize.bert(F.lower("text")))
    return _texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", subword.wordpiece_text(tokens).alias("text"))


# BERT's basic stage before WordPiece, for configurations without a pre-tokenizer


@query
def wp_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(_texts(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", subword.tokenize(subword.Basic())(pretokenize.blanks(F.col("text"))), "token")


def bert_tokenizer() -> Tokenizer:
    return Tokenizer.compile({"model": {"vocab": vocabularies.wordpiece().vocab}}, {"tokenizer_class": "BertTokenizer", "unk_token": "[UNK]"})


@query
def wp_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(_texts(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", bert_tokenizer().tokenize(F.col("text")), "token")


@query
def wp_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of texts that keep to 512 tokens, and a flag at those that do not."""
    rows = _texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", bert_tokenizer().encode(F.col("text")).alias("all"))
    ids = F.when(~subword.too_long(F.col("all")), F.array_join(F.transform("all", lambda x: x.cast("string")), " "))
    return rows.select("doc_id", F.size("all").cast("long").alias("n_tokens"), subword.too_long(F.col("all")).alias("too_long"), ids.alias("ids"))


# Pipeline operators


@query
def tok_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = F.array_join(pretokenize.bert(F.col("text")), " ")
    return _texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", decode.clean_up(spaced).alias("text"))


@query
def tok_added_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = {"added_tokens": [{"id": 900, "content": "the", "lstrip": True}, {"id": 901, "content": "and", "rstrip": True}, {"id": 902, "content": "."}]}
    tokenizer = Tokenizer.compile(data, {}, model=vocabularies.bpe())
    return _pieces(_texts(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", tokenizer.sections(F.col("text")))


def _wordpiece_tokens():
    return subword.tokenize(vocabularies.wordpiece())(pretokenize.bert(F.lower("text")))


@query
def tok_fuse_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", _wordpiece_tokens().alias("ts")).select("doc_id", subword.fuse_unknown(F.col("ts"), "[UNK]").alias("ts"))
    rows = rows.groupBy("doc_id").agg(F.sum(F.size("ts")).alias("n_tokens"), F.sum(F.size(F.filter("ts", lambda x: x == "[UNK]"))).alias("n_unk"))
    return rows.where("n_tokens > 0")


@query
def tok_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = vocabularies.wordpiece()
    rows = subword.lookup(_words(spark, sf_dir).withColumnRenamed("word", "token"), subword.vocab_table(model, spark), model.unk_id)
    return rows.select("token", "id")


@query
def uni_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = vocabularies.unigram()
    rows = subword.lookup(_words(spark, sf_dir).withColumnRenamed("word", "token"), subword.vocab_table(model, spark), model.unk_id)
    return rows.select("token", "id")


@query
def tok_unk_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces, model = pretokenize.bert(F.lower("text")), vocabularies.wordpiece()
    n, unk = subword.count_tokens(model)(pieces), subword.count_tokens(model, only="[UNK]")(pieces)
    rows = _texts(spark, sf_dir, "documents", "lang", "text").select("lang", n.alias("n"), unk.alias("u"))
    return rows.groupBy("lang").agg(F.sum("n").alias("n_tokens"), F.sum("u").alias("n_unk")).where("n_tokens > 0")


# Post-processors and chats on conversations


def _turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each user turn with the assistant turn that follows it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = _read(spark, d, "conversations").withColumns({"next_role": F.lead("role").over(w), "next_text": F.lead("text").over(w)})
    a, b = pretokenize.whitespace(F.col("text")), pretokenize.whitespace(F.col("next_text"))
    return rows.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", a.alias("a"), b.alias("b"))


_POST = {
    "post_bert_single": lambda a, b: post.bert("[CLS]", "[SEP]")(a),
    "post_bert_pair": lambda a, b: post.bert("[CLS]", "[SEP]")(a, b),
    "post_roberta_pair": lambda a, b: post.roberta("<s>", "</s>")(F.transform(a, lambda x: F.concat(F.lit("  "), x)), b),
    "post_template": lambda a, b: post.template([("special", "<s>"), ("A", "")], [("special", "<s>"), ("A", ""), ("special", "</s>"), ("B", ""), ("special", "</s>")])(a, b),
    "post_sequence": lambda a, b: post.postprocessor({"type": "Sequence", "processors": [{"type": "ByteLevel"}, {"type": "BertProcessing", "cls": ["<s>", 0], "sep": ["</s>", 1]}]})(a, b),
}
for _name, _f in _POST.items():
    QUERIES[_name] = lambda spark, d, f=_f: _turn_pairs(spark, d).select("conv_id", "turn", F.array_join(f(F.col("a"), F.col("b")), " ").alias("tokens"))

_CHAT = {"chat_chatml": chat.chatml, "chat_generation_prompt": lambda m: chat.chatml(m, True), "chat_llama_inst": chat.llama_inst}
for _name, _f in _CHAT.items():
    QUERIES[_name] = lambda spark, d, f=_f: chat.messages(_read(spark, d, "conversations")).select("conv_id", f(F.col("messages")).alias("rendered"))

_TEMPLATE = """{% for message in messages %}
<|im_start|>{{ message['role'] }}
{{ message.content + '<|im_end|>' }}
{% endfor %}"""


@query
def chat_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.messages(_read(spark, sf_dir, "conversations")).select("conv_id", chat.render(_TEMPLATE, {})(F.col("messages")).alias("rendered"))


@query
def chat_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = Tokenizer.compile({"pre_tokenizer": {"type": "ByteLevel"}}, {"chat_template": _TEMPLATE, "model_max_length": 256}, model=vocabularies.bpe())
    ids = tokenizer.apply_chat_template(F.col("messages"), add_generation_prompt=False, truncation=True, max_length=200)
    return chat.messages(_read(spark, sf_dir, "conversations")).select("conv_id", F.size(ids).cast("long").alias("n_tokens"))


# Logits: embeddings stand for scores of a vocabulary of as many tokens as they are wide


def _logits(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("token_id", "score"))
    return rows.select("row_id", F.col("token_id").cast("long").alias("token_id"), (F.col("score").cast("double") * 10).alias("score"))


def _inputs(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.explode(F.array(F.col("vec_id") % 64, (F.col("vec_id") * 7) % 64, F.col("vec_id") % 64)).alias("token_id"))


def _kept(df: DataFrame) -> DataFrame:
    return df.select("row_id", "token_id", (F.col("score") > float("-inf")).alias("kept"))


QUERIES["logit_temperature"] = lambda spark, d: logits.temperature(0.7)(_logits(spark, d)).select("row_id", "token_id", F.round("score", 6).alias("score"))
QUERIES["logit_topk"] = lambda spark, d: _kept(logits.top_k(5)(_logits(spark, d)))
QUERIES["logit_topp"] = lambda spark, d: _kept(logits.top_p(0.9)(_logits(spark, d)))
QUERIES["logit_minp"] = lambda spark, d: _kept(logits.min_p(0.1)(_logits(spark, d)))
QUERIES["logit_repetition"] = lambda spark, d: logits.repetition(1.3, _inputs(spark, d))(_logits(spark, d)).select("row_id", "token_id", F.round("score", 6).alias("score"))
QUERIES["logit_softmax"] = lambda spark, d: _logits(spark, d).select("row_id", "token_id", F.round(logits.softmax(), 6).alias("p"))
QUERIES["logit_greedy"] = lambda spark, d: logits.greedy(_logits(spark, d))


@query
def logit_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = logits.GenerationConfig(temperature=0.7, top_k=20, top_p=0.9, min_p=0.02, repetition_penalty=1.3)
    return _kept(logits.apply(_logits(spark, sf_dir), logits.plan(config, _inputs(spark, sf_dir))))


@query
def logit_sample_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logits.sample(_logits(spark, sf_dir), (F.col("row_id") * 37 % 101 + 0.5) / 101)


@query
def logit_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A processor of the registry as a table function in SQL, each row a part of its own."""
    tables.register_functions(spark, processors={"tessera_epsilon": tables.processor("epsilon_cutoff", epsilon=0.02)})
    return spark.sql("SELECT row_id, token_id, score > double('-infinity') AS kept FROM tessera_epsilon(TABLE({logits}) PARTITION BY row_id)", logits=_logits(spark, sf_dir))


@query
def wp_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each part's name and type, by a table function in SQL."""
    tables.register_functions(spark, models={"tessera_wordpiece": vocabularies.wordpiece()})
    rows = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), pretokenize.whitespace(F.lower(F.concat_ws(" ", "p_name", "p_type"))).alias("pieces"))
    return spark.sql("SELECT row_id AS p_partkey, pos, token FROM tessera_wordpiece(TABLE({rows}))", rows=rows)


# Generation


@query
def gen_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modes of configurations made of orders' numbers."""
    key = F.col("o_orderkey")
    bit = lambda n: F.floor(key / n) % 2
    df = _read(spark, sf_dir, "orders").select(
        "o_orderkey", (1 + bit(1)).cast("int").alias("beams"), (1 + bit(2)).cast("int").alias("beam_groups"), (bit(4) == 1).alias("sample"), F.when(bit(8) == 1, 50).otherwise(1).alias("k"),
        F.when(F.floor(key / 16) % 3 == 1, 0.0).when(F.floor(key / 16) % 3 == 2, F.col("o_totalprice") / 1e6).alias("alpha"),
    )
    return df.withColumn("mode", logits.mode(*(F.col(c) for c in df.columns[1:])))


def _loop(spark: SparkSession, sf_dir: str, n_steps: int, eos_token_id: int | None = None) -> DataFrame:
    best = logits.greedy(_logits(spark, sf_dir)).select(F.col("row_id").alias("token_id"), F.col("token_id").alias("next_id"))
    prompts = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq_id"), (F.col("vec_id") % 64).alias("token_id"))
    return generate.follow(prompts, best, n_steps, eos_token_id=eos_token_id).withColumn("step", F.col("step").cast("long"))


@query
def gen_loop_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loop(spark, sf_dir, 8)


@query
def gen_loop_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To the end token, or 50 steps where none comes."""
    return _loop(spark, sf_dir, 50, eos_token_id=7)


@query
def lm_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.transform(F.filter(F.split("text", ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    padded, mask = generate.pad(ids, 512)
    joined = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), " ")
    return _read(spark, sf_dir, "benchmark").select("item_id", joined(padded).alias("ids"), joined(mask).alias("mask"))


@query
def lm_default_gen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of models that are named after documents' sources, some with gpt."""
    name = F.concat("source", F.element_at(F.array(F.lit("-GPT-neo"), F.lit("/my-gpt2"), F.lit("-llama")), (F.col("doc_id") % 3 + 1).cast("int")))
    names = _read(spark, sf_dir, "documents").select("doc_id", name.alias("name"))
    return names.select("doc_id", "name", generate.default_config(F.col("name")).alias("c")).select("doc_id", "name", "c.*").withColumns({c: F.col(c).cast("long") for c in ("max_new_tokens", "top_k")})


@query
def cli_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("<s>"), F.replace("text", F.lit("."), F.lit("\\n")), F.lit("</s>"))
    return _read(spark, sf_dir, "benchmark").select("item_id", generate.show(marked).alias("text"))


# Tries, maps and files


@query
def trie_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.createDataFrame([(g,) for g in vocabularies.GROUPS], "entry string")
    return subword.prefix_join(_words(spark, sf_dir), entries, "word", "entry", max(map(len, vocabularies.GROUPS))).select("word", "entry")


@query
def map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").cast("string").alias("value"))
    region = _read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").cast("string").alias("value"))
    return files.merge_maps(nation, region)


@query
def file_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").where(files.matches(F.col("url"), ["*.html", "http://blog.*/en/*"])).select("page_id", "url")


@query
def file_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", files.file_hash(F.col("text")).alias("sha256"))


@query
def file_valid_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.sha2("text", 256)
    some = F.when(F.col("doc_id") % 3 == 0, h).when(F.col("doc_id") % 3 == 1, F.substring(h, 1, 40)).otherwise(F.upper(h))
    return _read(spark, sf_dir, "documents").select("doc_id", files.is_commit(some).alias("is_commit"), files.is_sha256(some).alias("is_sha256"))


@query
def download_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, k = F.sha2("text", 256), F.col("doc_id") % 5
    commit = F.substring(h, 1, 40)
    local = F.when(k == 0, commit).when(k < 4, F.reverse(commit))
    known = F.when(k == 1, h).when(k == 2, F.lit("old"))
    own = F.when(k == 3, h).otherwise(F.reverse(h))
    return _read(spark, sf_dir, "documents").select("doc_id", files.download_decision(local, commit, known, h, own).alias("decision"))


@query
def progress_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _read(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.floor(F.sum(F.floor(F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(0.0)))).over(w) / 50).cast("long").alias("completed"))
    rows = rows.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    found = progress.changes(rows, "user_id", "at", "completed")
    return found.select("user_id", "event_id", "completed", F.col("delta").cast("long").alias("delta"))


@query
def progress_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as samples of a transfer that is complete at the last of them, and whose total grows a little with each."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    some = F.floor(F.sum(F.floor(F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(0.0)))).over(w) / 50).cast("long")
    rows = _read(spark, sf_dir, "events").where("user_id IS NOT NULL AND ts IS NOT NULL").withColumns({"completed": some, "complete": F.lead("event_id").over(w).isNull()})
    total = F.max("completed").over(Window.partitionBy("user_id")) + F.row_number().over(w)
    samples = rows.select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), "completed", total.alias("total"), "complete")
    return progress.reports(samples, "user_id").select("user_id", "ts", F.round("fraction", 6).alias("fraction"), F.round("speed", 6).alias("speed"))


# Configurations as data: JSON made from orders


def _settings(spark: SparkSession, d: str) -> DataFrame:
    """(o_orderkey, v): a configuration of each order, whose entries are of a kind that goes by its key."""
    key = F.col("o_orderkey")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    kinds = [F.col("o_custkey").cast("string"), F.concat(F.floor("o_totalprice"), F.lit(".25")), quoted("o_orderpriority"), F.lit("true"), F.lit("null"), F.lit('"T"'), F.concat(F.lit('["<s>", '), F.col("o_custkey"), F.lit("]"))]
    kinds += [F.concat(F.lit("["), F.col("o_custkey"), F.lit(', "<s>"]')), F.lit('{"a": 1, "b": [1, 2.5, "x,]"]}'), F.lit('"0"'), F.lit("1")]
    value = F.element_at(F.array(*kinds), (key % 11 + 1).cast("int"))
    other = F.element_at(F.array(*kinds), (F.floor(key / 11) % 11 + 1).cast("int"))
    text = F.concat(F.lit('\ufeff{"orderStatus": '), quoted("o_orderstatus"), F.lit(', "model_max": '), value, F.lit(', "modelMin": '), other, F.lit(', "list": ['), value, F.lit(", "), other, F.lit(', 7, ], "none": null,}'))
    return _texts(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority").select("o_orderkey", variants.parse(text).alias("v"))


@query
def cfg_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by key, by another spelling, by place; missing ones are null."""
    at = lambda *path: variants.encode(variants.get(F.col("v"), *path))
    return _settings(spark, sf_dir).select(
        "o_orderkey", at("orderStatus").alias("own"), at("modelMax").alias("snake"), at("modelMin").alias("camel"), at("list", 1).alias("placed"), at("list", 3).alias("beyond"),
        at("model_min").alias("no_camel"), at("modelMax", "b", 2).alias("deep"), variants.is_null(variants.get(F.col("v"), "none")).alias("none"), variants.is_null(variants.get(F.col("v"), "missing")).alias("missing"),
    )


@query
def cfg_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = variants.get(F.col("v"), "modelMax")
    return _settings(spark, sf_dir).select(
        "o_orderkey", variants.kind(v).alias("kind"), variants.string(v).alias("string"), variants.integer(v, -1).alias("integer"), variants.boolean(v).alias("boolean"), variants.floating(v).cast("double").alias("floating"),
        F.size(variants.array(v)).cast("long").alias("items"), F.array_join(F.map_keys(variants.dictionary(v)), ",").alias("keys"),
    )


@query
def cfg_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (variants.get(F.col("v"), k) for k in ("modelMax", "modelMin"))
    return _settings(spark, sf_dir).select("o_orderkey", variants.equals(a, b).alias("equal"), variants.equals(b, a).alias("turned"), (variants.hashed(a) == variants.hashed(b)).alias("same_hash"))


@query
def cfg_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = variants.token(variants.get(F.col("v"), "modelMax"))
    return _settings(spark, sf_dir).select("o_orderkey", found["id"].alias("id"), found["token"].alias("token"))


@query
def cfg_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of each event's properties merged with its type."""
    own = F.to_variant_object(F.create_map(F.lit("eventType"), F.col("event_type"), F.lit("k"), F.lit("old")))
    rows = _read(spark, sf_dir, "events").select("event_id", variants.merged(own, variants.parse(F.col("props"))).alias("v"))
    return variants.entries(rows, "v").select("event_id", variants.uncamel(F.col("key")).alias("key"), variants.encode(F.col("value")).alias("value"))


# Strings by code points, and addresses of files


@query
def str_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons that tell a composed letter from the same letter and its accent apart, and slices by code points."""
    url, e, parts = F.col("url"), F.lit("\u00e9"), F.lit("e\u0301")
    return _read(spark, sf_dir, "pages").select(
        "page_id",
        (F.replace(url, F.lit("e"), e) == F.replace(url, F.lit("e"), parts)).alias("equal"),
        (F.replace(url, F.lit("e"), e) < F.replace(url, F.lit("e"), parts)).alias("less"),
        F.startswith(F.concat(parts, url), F.lit("e")).alias("starts"),
        F.endswith(F.concat(url, parts), e).alias("ends"),
        F.lower(F.concat(F.lit("\u00c9"), url)).alias("lowered"),
        F.substring(F.replace(url, F.lit("t"), parts), 3, 4).alias("sliced"),
    )


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("models"), F.lit("datasets"), F.lit("spaces")), (F.col("doc_id") % 3 + 1).cast("int"))
    repo, revision = F.concat_ws("/", "source", "lang"), F.concat(F.lit("refs/pr/"), F.col("doc_id").cast("string"))
    return _read(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), repo.alias("repo"), revision.alias("revision"))


@query
def file_local_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _addresses(spark, sf_dir).select("doc_id", files.local_path("/models", F.col("kind"), F.col("repo")).alias("path"))


@query
def file_resolve_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = files.resolve_url("https://example.com", F.col("kind"), F.col("repo"), F.col("revision"), F.lit("config.json"))
    return _addresses(spark, sf_dir).select("doc_id", url.alias("url"))


@query
def file_clean_etag(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.sha2("text", 256)
    tag = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('W/"'), h, F.lit('"'))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit('"'), h, F.lit('"'))).otherwise(h)
    return _read(spark, sf_dir, "documents").select("doc_id", files.clean_etag(tag).alias("etag"))


@query
def split_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the slashes of each url are."""
    found = F.explode(pretokenize.ranges(F.col("url"), "/+")).alias("r")
    return _read(spark, sf_dir, "pages").select("page_id", found).select("page_id", *(F.col(f"r.{c}").cast("long").alias(c) for c in ("start", "end")))
