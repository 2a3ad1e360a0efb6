"""Config, files, tensors, chats, logits, generation and streams."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import config
from tessera.config import Config
from tessera.operators import generate, logits
from tessera.plans import chat
from tessera.sources import files, tensors


def test_config():
    c = Config({"fooBar": 1, "snake_case": "x", "list": [1, "a", None], "pair": ["<s>", 7], "t": "T", "f": 2.5})
    assert c.snakeCase.string() == "x"
    assert c.fooBar.boolean() is True
    assert c["list"][1].string() == "a" and c["list"][9].is_null
    assert c.missing.deeper[3].string("d") == "d"
    assert c.pair.token() == (7, "<s>")
    assert c.t.boolean() is True and Config("no").boolean() is None and Config(2).boolean() is False
    assert c.f.floating() == 2.5 and Config(3).floating() == 3.0 and Config(True).integer() is None
    assert Config(1) == Config(True) and Config("a") != Config("b") and hash(Config("a")) == hash(Config("a"))
    assert config.uncamel("addBOSToken") == "add_bostoken"
    assert config.merge({"a": 1, "b": 2}, {"b": 3}) == {"a": 1, "b": 3}
    assert config.merge({"a": 1}, {"a": 3}, lambda x, y: x) == {"a": 1}


def test_relaxed_json():
    c = config.loads('﻿{"a": [1, 2,], "s": ",}", "x": Infinity, "n": NaN, "big": 99999999999999999999,}'.encode())
    assert c.a.native() == [1, 2] and c.s.string() == ",}" and c.x.native() == float("inf") and c.n.native() != c.n.native()
    assert isinstance(c.big.native(), float)
    with pytest.raises(ValueError):
        config.loads("{")


def test_files(spark, tmp_path):
    folder = tmp_path / "models/org/name"
    (folder / "sub").mkdir(parents=True)
    (folder / "config.json").write_text('{"model_type": "gpt2"}')
    (folder / "tokenizer.json").write_text("{}")
    (folder / "sub/a.bin").write_bytes(b"abc")
    names = {r.name for r in files.list_files(spark, str(folder)).collect()}
    assert names == {"config.json", "tokenizer.json", "sub/a.bin"}
    assert {r.name for r in files.list_files(spark, str(folder), ["*.json", "s*bin"]).collect()} == names
    assert {r.name for r in files.list_files(spark, str(folder), ["CONFIG*"]).collect()} == set()
    read = files.read_model_folder(folder)
    assert read["tokenizer_config"].tokenizerClass.string() == "GPT2Tokenizer"
    (folder / "chat_template.jinja").write_text("J")
    (folder / "tokenizer_config.json").write_text('{"x": 1}')
    read = files.read_model_folder(folder)["tokenizer_config"]
    assert read.chatTemplate.string() == "J" and read.x.integer() == 1
    (folder / "tokenizer.json").unlink()
    with pytest.raises(files.RepoError):
        files.read_model_folder(folder)
    with pytest.raises(files.RepoError):
        files.fallback_config("../x")
    assert files.tokenizer_config(Config({"a": 1}), Config({"model_type": "llama"})).tokenizerClass.string() == "LlamaTokenizer"


def test_metadata_and_checks(spark, tmp_path):
    data, meta = tmp_path / "data", tmp_path / "meta"
    data.mkdir()
    (data / "a.txt").write_bytes(b"abc")
    good, commit = hashlib.sha256(b"abc").hexdigest(), "0" * 40
    with pytest.raises(files.RepoError, match="no_repo"):
        files.validate_offline(spark, str(tmp_path / "none"), str(meta))
    meta.mkdir()
    files.write_metadata(meta / "b.txt.metadata", commit, "x", 1.5)
    (meta / "c.txt.metadata").write_text("one line")
    with pytest.raises(files.RepoError, match="invalid_metadata"):
        files.validate_offline(spark, str(data), str(meta))
    files.write_metadata(meta / "a.txt.metadata", commit, good, 1.5)
    files.validate_offline(spark, str(data), str(meta))
    assert {tuple(r) for r in files.read_metadata(spark, str(meta)).collect()} == {("a.txt", commit, good, 1.5), ("b.txt", commit, "x", 1.5)}
    files.write_metadata(meta / "a.txt.metadata", commit, "f" * 64, 1.5)
    with pytest.raises(files.RepoError, match="file_integrity"):
        files.validate_offline(spark, str(data), str(meta))
    assert files.hash_file(data / "a.txt") == good


def test_addresses(spark):
    row = spark.createDataFrame([("datasets", "a/b", "refs/pr/1", 'W/"abc"', '<http://x/2>; rel="next", <http://x/9>; rel="last"')], "kind string, repo string, rev string, etag string, link string")
    url = files.resolve_url("http://h", F.col("kind"), F.col("repo"), F.col("rev"), F.lit("c.json"))
    found = row.select(url, files.clean_etag(F.col("etag")), files.link_url(F.col("link"), "last"), files.link_url(F.col("link"), "prev"), files.local_path("/m", F.col("kind"), F.col("repo"))).head()
    assert tuple(found) == ("http://h/datasets/a/b/resolve/refs%2Fpr%2F1/c.json", "abc", "http://x/9", None, "/m/datasets/a/b")


def test_snapshot(spark):
    h = "a" * 64
    local = spark.createDataFrame([("same", "c" * 40, "e", h), ("tag", "d" * 40, "e", h), ("hash", None, None, h), ("old", "d" * 40, "x", "b" * 64)], "name string, commit string, etag string, sha256 string")
    remote = spark.createDataFrame([("same", "c" * 40, "z"), ("tag", "c" * 40, "e"), ("hash", "c" * 40, h), ("old", "c" * 40, h), ("new", "c" * 40, h)], "name string, commit string, etag string")
    assert {r.name: r.decision for r in files.snapshot(local, remote).collect()} == {"same": "keep_commit", "tag": "keep_etag", "hash": "keep_hash", "old": "download", "new": "download"}


def test_tensors(spark, tmp_path):
    made = {"i": np.array([1, 2, 3], dtype="<i4"), "d": np.array([[0.5, 1], [2, 3]], dtype="<f8"), "f": np.arange(24, dtype="<f4").reshape(2, 3, 4), "h": np.array([1.5], dtype="<f2")}
    tensors.write_tensors(str(tmp_path / "a.safetensors"), made)
    tensors.register(spark)
    rows = {r.name: r for r in spark.read.format("safetensors").load(str(tmp_path)).collect()}
    assert {k: (r.dtype, list(r.shape), list(r["values"])) for k, r in rows.items()} == {k: ({"<i4": "I32", "<f8": "F64", "<f4": "F32", "<f2": "F16"}[x.dtype.str], list(x.shape), [float(v) for v in x.ravel()]) for k, x in made.items()}
    empty = {"e": np.zeros((0, 3), dtype="<f4"), "big": np.arange(tensors.TASK + tensors.ROW + 5, dtype="<i4")}
    (tmp_path / "more").mkdir()
    tensors.write_tensors(str(tmp_path / "more" / "c.safetensors"), empty)
    for path in (f"{tmp_path}/more", f"file://{tmp_path}/more/*.safetensors", f"{tmp_path}/more/c.safetensors"):
        found = spark.read.format("safetensors").load(path).selectExpr("name", "start", "size(values) AS n", "get(values, 0) AS first", "shape").collect()
        assert sorted(r.start for r in found if r.name == "big") == list(range(0, tensors.TASK + tensors.ROW + 5, tensors.ROW))
        assert all(r.first == r.start for r in found if r.name == "big") and sum(r.n for r in found) == len(empty["big"])
        assert [(r.start, r.n, r["shape"]) for r in found if r.name == "e"] == [(0, 0, [0, 3])]
    (tmp_path / "b.safetensors").write_bytes(b"GGUFxxxxxxxx")
    with pytest.raises(tensors.TensorError):
        tensors.read_header(str(tmp_path / "b.safetensors"))
    with pytest.raises(tensors.TensorError):
        tensors.read_header(str(tmp_path / "b.txt"))
    with pytest.raises(tensors.TensorError):
        tensors.read_tensor("x", "u", {"dtype": "U64", "data_offsets": [0, 8], "shape": [1]}, 0)


WHITESPACE = """{% for message in messages %}
    {% if message['role'] == 'user' %}
{{ message['content'] }}
    {% endif %}
{% endfor %}
{% if add_generation_prompt %}
assistant
{% endif %}
"""


def test_templates():
    user = [{"role": "user", "content": "Hi"}]
    assert chat.Template(WHITESPACE).render({"messages": user, "add_generation_prompt": True}) == "Hi\nassistant\n"
    source = "{%- for m in messages if_ %}".replace(" if_", "") + "{{ loop.index }}{{ m.role | upper }}{% if not loop.last %}, {% elif loop.first %}!{% else %}.{% endif %}{%- endfor %}"
    assert chat.Template(source).render({"messages": user * 2}) == "1USER, 2USER."
    assert chat.Template("{% set x = 'a' ~ 1 %}{{ x + 'b' }}{{ tools | tojson }}{{ y is defined }}{{ 'q' in 'aq' and none is none }}").render({"tools": [{"k": "é"}]}) == 'a1b[{"k": "é"}]FalseTrue'
    assert chat.Template("{{ messages[0]['content'][1:] }}{{ messages | length }}{{ -1 if false else 2 }}{# no #}").render({"messages": user}) == "i12"
    with pytest.raises(chat.TemplateError, match="bad"):
        chat.Template("{{ raise_exception('bad') }}").render({})
    for wrong in ("{% for x in y %}", "{% include 'a' %}", "{{ a b }}", "{% endif %}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(wrong)


def test_template_choice():
    named = Config([{"name": "default", "template": "D"}, {"name": "tool_use", "template": "T"}, {"name": "x", "template": "X"}])
    assert chat.select(named) == "D"
    assert chat.select(named, tools=[{}]) == "T"
    assert chat.select(named, chat.Choice(name="x"), [{}]) == "X"
    assert chat.select(named, chat.Choice(literal="L")) == "L"
    assert chat.select(Config("S"), chat.Choice(name="ignored")) == "S"
    for c, choice in ((named, chat.Choice(name="none")), (Config(), None)):
        with pytest.raises(chat.TemplateError):
            chat.select(c, choice)


def scores(spark, *rows):
    return spark.createDataFrame([(r, i, float(s)) for r, row in enumerate(rows) for i, s in enumerate(row)], "row_id long, token_id long, score double")


def back(df):
    found = {}
    for r in df.orderBy("row_id", "token_id").collect():
        found.setdefault(r.row_id, []).append(r.score)
    return list(found.values())


def test_logits(spark):
    inf = float("-inf")
    assert back(logits.temperature(2)(scores(spark, [2, 4]))) == [[1, 2]]
    assert back(logits.top_k(2)(scores(spark, [1, 5, 3, 3, 0], [1, 2, 3, 4, 5]))) == [[inf, 5, 3, 3, inf], [inf, inf, inf, 4, 5]]
    assert back(logits.top_k(9)(scores(spark, [1, 5]))) == [[1, 5]]
    p = list(np.log([0.1, 0.2, 0.5, 0.2]))
    assert back(logits.top_p(0.6)(scores(spark, p))) == [[inf, p[1], p[2], inf]]
    assert back(logits.top_p(0.0)(scores(spark, p))) == [[inf, inf, p[2], inf]]
    assert back(logits.top_p(0.0, min_keep=2)(scores(spark, p))) == [[inf, p[1], p[2], inf]]
    assert back(logits.min_p(0.3)(scores(spark, p))) == [[inf, p[1], p[2], p[3]]]
    inputs = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1)], "row_id long, token_id long")
    assert back(logits.repetition(2, inputs)(scores(spark, [1, -1, 3], [1, -1, 3]))) == [[0.5, -2, 3], [1, -2, 3]]
    for bad in (lambda: logits.temperature(0), lambda: logits.top_k(0), lambda: logits.top_p(1.5), lambda: logits.min_p(-1), lambda: logits.repetition(0, inputs), lambda: logits.top_p(0.5, min_keep=0)):
        with pytest.raises(ValueError):
            bad()
    assert [r.token_id for r in logits.greedy(scores(spark, [1, 3, 3], [5, 1, 1])).orderBy("row_id").collect()] == [1, 0]
    assert [r.token_id for r in logits.sample(scores(spark, p, p), F.when(F.col("row_id") == 0, 0.05).otherwise(0.5)).orderBy("row_id").collect()] == [0, 2]
    assert len(logits.plan(logits.GenerationConfig())) == 1
    assert len(logits.plan(logits.GenerationConfig(temperature=0.5, top_p=0.9, min_p=0.1, top_k=0, repetition_penalty=1.1), inputs)) == 4


def mock(ids):
    x = np.zeros(10)
    x[{1: 5, 2: 3, 3: 5}.get(len(ids), 0)] = 10
    return x


def test_generation(spark):
    prompts = spark.createDataFrame([(1, [0]), (2, [0, 1])], "seq_id long, ids array<long>")
    config = logits.GenerationConfig(max_length=4)
    rows = {r.seq_id: list(r.ids) for r in generate.generate(prompts, mock, config).collect()}
    assert rows == {1: [0, 5, 3, 5], 2: [0, 1, 3, 5]}
    steps = generate.generate(prompts.where("seq_id = 1"), mock, config, every_step=True).orderBy("step").collect()
    assert [list(r.ids) for r in steps] == [[0, 5], [0, 5, 3], [0, 5, 3, 5]]
    assert [list(r.ids) for r in generate.generate(prompts, mock, logits.GenerationConfig(max_length=9, eos_token_id=3)).orderBy("seq_id").collect()] == [[0, 5], [0, 1]]
    seven = lambda ids: np.where(np.arange(10) == 7, 10.0, 1.0)
    assert list(generate.steps(seven, [0], config))[-1] == [0, 7, 7, 7]
    assert list(generate.steps(seven, [0], logits.GenerationConfig(max_length=3, repetition_penalty=20.0)))[-1] == [0, 7, 1]
    with pytest.raises(ValueError):
        list(generate.steps(mock, [0], logits.GenerationConfig(num_beams=2)))
    sampled = logits.GenerationConfig(max_length=6, do_sample=True, top_k=3, top_p=0.9, min_p=0.05, temperature=0.8)
    again = [[list(r.ids) for r in generate.generate(prompts, mock, sampled, seed=3).orderBy("seq_id").collect()] for _ in range(2)]
    assert again[0] == again[1] and all(0 <= i < 10 for ids in again[0] for i in ids)


def test_generation_by_a_table(spark):
    """Paths by doubling are the walk, to an end token, a token without a row, or any number of steps."""
    rng = np.random.default_rng(2)
    table = {t: int(rng.integers(0, 40)) for t in range(36)}
    transitions = spark.createDataFrame(list(table.items()), "token_id long, next_id long")
    prompts = spark.createDataFrame([(i, i % 41) for i in range(90)], "seq_id long, token_id long")
    for n, eos in ((1, None), (5, None), (8, table[3]), (37, table[0])):
        expected = []
        for i in range(90):
            now, step = i % 41, 0
            expected.append((i, 0, now))
            while step < n and table.get(now) is not None and table[now] != eos:
                now, step = table[now], step + 1
                expected.append((i, step, now))
        rows = generate.follow(prompts, transitions, n, eos_token_id=eos)
        assert sorted(map(tuple, rows.select("seq_id", "step", "token_id").collect())) == expected
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    with pytest.raises(ValueError):
        generate.paths(transitions, 0)


def test_stateful_model():
    calls = []

    def call(ids, state):
        calls.append(list(ids))
        return mock([0] * (state + len(ids))), state + len(ids)

    model = generate.Stateful(lambda: 0, call)
    assert list(generate.steps(model, [0], logits.GenerationConfig(max_length=4)))[-1] == [0, 5, 3, 5]
    assert calls == [[0], [5], [3]]
    model.reset()
    assert list(generate.steps(model, [0], logits.GenerationConfig(max_length=2)))[-1] == [0, 5]
    assert generate.causal_mask(3).shape == (1, 1, 1, 4)


def test_text_generation(spark):
    from tessera.queries import bpe_tokenizer

    tokenizer = bpe_tokenizer()
    a = tokenizer.model.vocab["a"]
    always = lambda ids: np.eye(300)[a]
    prompts = spark.createDataFrame([(1, "the b")], "seq_id long, text string")
    assert generate.generate_text(prompts, tokenizer, always, logits.GenerationConfig(), 3).head().text == "the baaa"


def test_pad(spark):
    row = spark.createDataFrame([([5, 6],)], "ids array<long>").select(*generate.pad(F.col("ids"), 4)).head()
    assert [list(x) for x in row] == [[5, 6, 0, 0], [1, 1, 0, 0]]


def test_language_model(spark, tmp_path):
    from tessera.plans.language_model import LanguageModel, Padded
    from tessera.plans.tokenizer import TokenizerError

    (tmp_path / "tokenizer.json").write_text('{"model": {"vocab": {"[UNK]": 0, "a": 1, "b": 2, "c": 3}}, "decoder": {"type": "WordPiece", "prefix": "##"}}')
    (tmp_path / "config.json").write_text('{"model_type": "bert", "bos_token_id": 5, "eos_token_id": 3, "task_specific_params": {"text-generation": {"do_sample": false}}}')
    (tmp_path / "tokenizer_config.json").write_text('{"unk_token": "[UNK]", "eos_token": "c"}')
    seen = []

    def network(ids, mask):
        seen.append((list(ids), list(mask)))
        return np.eye(4)[np.minimum(ids + 1, 3)]

    scores = Padded(network, 4, pad_id=9)
    assert list(scores([0, 1])) == [0, 0, 1, 0] and seen == [([0, 1, 9, 9], [1, 1, 0, 0])]
    for bad in ([], [0] * 5):
        with pytest.raises(ValueError):
            scores(bad)
    model = LanguageModel.from_folder(tmp_path, Padded(lambda ids, mask: np.eye(4)[np.minimum(ids + 1, 3)], 8), "my-GPT")
    assert (model.model_type, model.bos_token_id, model.eos_token_id, model.default_do_sample) == ("bert", 5, 3, False)
    assert (model.default_generation_config.do_sample, model.default_generation_config.max_new_tokens) == (True, 2048)
    assert model.tokenizer is model.tokenizer
    config = logits.GenerationConfig()
    assert model.generate(spark.createDataFrame([(1, [1])], "seq_id long, ids array<long>"), logits.GenerationConfig(eos_token_id=3)).head().ids == [1, 2]
    assert model.generate_text(spark.createDataFrame([(1, "A")], "seq_id long, text string"), config, 1).head().text == "a b"
    with pytest.raises(TokenizerError, match="missing_config"):
        LanguageModel("x", scores, model.model_config, files.Config(), model.tokenizer_data).tokenizer


def test_materialized_snapshot(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    (a / "sub").mkdir(parents=True)
    (a / "sub" / "x.bin").write_bytes(b"12345")
    (a / "y.bin").write_bytes(b"")
    h = hashlib.sha256(b"12345").hexdigest()
    remote = spark.createDataFrame([("sub/x.bin", "c" * 40, h), ("y.bin", "c" * 40, "e")], "name string, commit string, etag string")
    local = spark.createDataFrame([("y.bin", "c" * 40, "e", None)], "name string, commit string, etag string, sha256 string")
    done = files.materialize(files.snapshot(local, remote), str(a), str(b)).collect()
    assert {(r.name, r.decision, r.bytes) for r in done} == {("sub/x.bin", "download", 5), ("y.bin", "keep_commit", 0)}
    assert (b / "sub" / "x.bin").read_bytes() == b"12345" and [p.name for p in (b / "sub").iterdir()] == ["x.bin"]
    assert {r.name for r in files.read_metadata(spark, str(b / ".metadata")).collect()} == {"sub/x.bin", "y.bin"}
    bad = spark.createDataFrame([("../z", "c" * 40, "e", "download")], "name string, commit string, etag string, decision string")
    with pytest.raises(Exception, match="leaves the folder"):
        files.materialize(bad, str(a), str(b)).collect()
