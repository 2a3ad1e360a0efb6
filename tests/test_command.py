"""The command line: texts as they grow, rates, and tables of prompts."""

import json

import numpy as np
import pytest

from tessera.plans import command

WORDS = ["one", "two", "three", "four", "five", "stop"]


def scores(ids):
    """The word after the last one."""
    return np.eye(len(WORDS))[min(ids[-1] + 1, len(WORDS) - 1)]


@pytest.fixture
def model_folder(tmp_path):
    folder = tmp_path / "model"
    folder.mkdir()
    vocab = {"[UNK]": 6, **{w: i for i, w in enumerate(WORDS)}}
    (folder / "config.json").write_text(json.dumps({"model_type": "bert", "eos_token_id": 5}))
    (folder / "tokenizer_config.json").write_text(json.dumps({"tokenizer_class": "BertTokenizer", "unk_token": "[UNK]"}))
    (folder / "tokenizer.json").write_text(json.dumps({"model": {"type": "WordPiece", "vocab": vocab, "unk_token": "[UNK]"}, "pre_tokenizer": {"type": "Whitespace"}, "decoder": {"type": "WordPiece", "prefix": "##", "cleanup": False}}))
    return folder


def test_tokens_as_they_come(spark, model_folder, capsys):
    wrote = []
    command.main([str(model_folder), "test_command:scores", "--prompt", "one", "--max-new-tokens", "10", "--no-sample"], spark, wrote.append)
    assert "".join(wrote) == "one two three four five\n"
    assert len(wrote) == 5  # each new word by itself, the first with its prompt, and the end of the line
    said = capsys.readouterr().err
    assert "4 tokens, " in said and "prefill" in said


def test_several_prompts_and_their_limit(spark, model_folder):
    from tessera.plans.language_model import LanguageModel

    wrote = []
    model = LanguageModel.from_folder(model_folder, scores)
    config = command.settings(command.parser().parse_args(["", "", "--max-new-tokens", "2"]), model)
    rates = command.run(spark, model, ["one", "four", "five"], config, wrote.append)
    assert wrote == ["[0] one two\n", "[1] four five\n", "[0]  three\n"]
    assert rates.tokens == 3 and rates.later == 1 and rates.prefill > 0 and rates.per_second > 0


def test_table_of_prompts(spark, model_folder, tmp_path):
    spark.createDataFrame([(1, "two"), (2, "four three")], "seq_id long, text string").write.parquet(f"{tmp_path}/in")
    command.main([str(model_folder), "test_command:scores", "--prompts", f"{tmp_path}/in", "--output", f"{tmp_path}/out", "--max-new-tokens", "2"], spark)
    assert {r.seq_id: r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {1: "two three four", 2: "four three four five"}


def test_flags(model_folder):
    from tessera.plans.language_model import LanguageModel

    model = LanguageModel.from_folder(model_folder, scores)
    config = command.settings(command.parser().parse_args(["", "", "--sample", "--top-k", "3", "--temperature", "0.5"]), model)
    assert (config.do_sample, config.top_k, config.temperature, config.max_new_tokens, config.eos_token_id) == (True, 3, 0.5, 128, 5)
    with pytest.raises(SystemExit):
        command.main(["a", "b"])
    with pytest.raises(SystemExit):
        command.main(["a", "b", "--prompts", "x"])
