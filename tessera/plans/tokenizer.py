"""Tokenizers: a configuration compiled into Column expressions.

    tokenizer = Tokenizer.compile(tokenizer_data, tokenizer_config)
    df.select(tokenizer.encode(F.col("text")))

Splitting at added tokens, normalizing and pre-tokenizing are native (Unicode forms alone need a UDF); the model is one Arrow
UDF over arrays of pieces; post-processing is native again. Vocabularies are fixed in size."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions import decode as dec
from tessera.functions import text as t
from tessera.functions.normalize import normalizer
from tessera.functions import pretokenize as pretokenizer
from tessera.functions.post import on_ids as post_on_ids
from tessera.functions.post import postprocessor
from tessera.operators import subword
from tessera.plans import chat
from tessera.sources.files import read_model_folder


class TokenizerError(ValueError):
    """`kind` is one of: missing_config, missing_class, unsupported_class, missing_vocab, malformed_vocab, chat_template, missing_chat_template,
    too_long, mismatched_config."""

    def __init__(self, kind: str, what: str = ""):
        super().__init__(f"{kind}: {what}" if what else kind)
        self.kind = kind


#: Tokenizer classes by name (without Fast) and the model behind each.
CLASSES = {
    "BertTokenizer": "WordPiece", "DistilbertTokenizer": "WordPiece", "DistilBertTokenizer": "WordPiece", "RobertaTokenizer": "BPE", "CodeGenTokenizer": "BPE", "CodeLlamaTokenizer": "BPE",
    "CohereTokenizer": "BPE", "FalconTokenizer": "BPE", "GemmaTokenizer": "BPE", "GPT2Tokenizer": "BPE", "LlamaTokenizer": "BPE", "WhisperTokenizer": "BPE", "Qwen2Tokenizer": "BPE",
    "PreTrainedTokenizer": "BPE", "TokenizersBackend": "BPE", "T5Tokenizer": "Unigram", "XLMRobertaTokenizer": "Unigram", "Xlm-RobertaTokenizer": "Unigram",
}

SPECIALS = ("bos_token", "eos_token", "unk_token", "sep_token", "pad_token", "cls_token", "mask_token", "additional_special_tokens")


def added_token_string(c: Config) -> str | None:
    """A string, or the content of an object."""
    return c.string() if c.string() is not None else c["content"].string()


def make_model(data: Config, config: Config, kind: str) -> subword.Model:
    model, added = data.model, {a["content"].string(): a["id"].integer() for a in data.addedTokens.array() if a["content"].string() is not None}
    vocab, unk = model.vocab, added_token_string(model.unkToken) or added_token_string(config.unkToken)
    if vocab.is_null:
        raise TokenizerError("missing_vocab")
    if kind == "Unigram":
        if model.unkId.integer() is None:
            raise TokenizerError("malformed_vocab", "unk_id")
        return subword.Unigram([(x[0].string(), x[1].floating()) for x in vocab.array()], model.unkId.integer())
    table = {k: v.integer() for k, v in vocab.dictionary().items()}
    if kind == "WordPiece":
        basic = subword.Basic(config.doLowerCase.boolean(True), config.handleChineseChars.boolean(True))
        return subword.WordPiece(table, unk or "[UNK]", added=added, basic=basic)
    merges = [tuple(x.string() for x in m.array()) if m.array() else m.string() for m in model.merges.array()]
    return subword.Bpe(table, merges, unk, (config.fuseUnk if not config.fuseUnk.is_null else model.fuseUnk).boolean(False), added)


def model_kind(name: str | None, strict: bool = True) -> str:
    if not name:
        raise TokenizerError("missing_class")
    name = name.removesuffix("Fast").replace("Fast", "")
    if name not in CLASSES and strict:
        raise TokenizerError("unsupported_class", name)
    return CLASSES.get(name, "BPE")


def llama_post(config: Config, post: Config) -> dict[str, Any] | None:
    """A template post-processor made from add_bos_token and add_eos_token, unless there is a template already."""
    if post.type.string() == "TemplateProcessing":
        return None
    bos, eos = config.addBosToken.boolean(True), config.addEosToken.boolean(False)
    names = {"bos": added_token_string(config.bosToken), "eos": added_token_string(config.eosToken)}
    for flag, key in ((bos, "bos"), (eos, "eos")):
        if flag and names[key] is None:
            raise TokenizerError("mismatched_config", f"add_{key}_token without {key}_token")

    def items(kind: str, type_id: int) -> list[dict]:
        special = lambda x: [{"SpecialToken": {"id": names[x], "type_id": type_id}}]
        return (special("bos") if bos else []) + [{"Sequence": {"id": kind, "type_id": type_id}}] + (special("eos") if eos else [])

    return {"type": "TemplateProcessing", "single": items("A", 0), "pair": items("A", 0) + items("B", 1)}


@dataclass
class Tokenizer:
    data: Config
    config: Config
    model: subword.Model
    llama: bool = False
    added: list[tuple[str, bool, bool]] = field(default_factory=list)
    specials: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def compile(data: Config | dict, config: Config | dict | None = None, strict: bool = True, model: subword.Model | None = None, legacy_folder_dispatch: bool = False) -> Tokenizer:
        """With legacy_folder_dispatch the llama rules do not apply, whatever the class."""
        data, config = Config.of(data), Config.of(config or {})
        name = config.tokenizerClass.string()
        kind = model_kind(name, strict) if model is None else ""
        llama = not legacy_folder_dispatch and (name or "").replace("Fast", "") in ("LlamaTokenizer", "CodeLlamaTokenizer")
        if llama:
            value = dict(data.value)
            if not config.legacy.boolean(True):
                value.pop("normalizer", None)
                value["pre_tokenizer"] = {"type": "Metaspace", "replacement": t.UNDERLINE, "add_prefix_space": True, "prepend_scheme": "first"}
            made = llama_post(config, data.postProcessor)
            data = Config({**value, **({"post_processor": made} if made else {})})
        model = model or make_model(data, config, kind)
        tokens = [(a["content"].string(), a["lstrip"].boolean(False), a["rstrip"].boolean(False)) for a in data.addedTokens.array() if a["content"].string() is not None]
        specials = {a["content"].string(): a["id"].integer() for a in data.addedTokens.array() if a["special"].boolean(False)}
        return Tokenizer(data, config, model, llama and not config.legacy.boolean(True), sorted(tokens, key=lambda x: -len(x[0])), specials)

    @staticmethod
    def from_folder(folder: str, strict: bool = True, legacy_folder_dispatch: bool = False) -> Tokenizer:
        """The tokenizer of a model folder: tokenizer.json, with tokenizer_config.json, config.json and a chat template if there are any."""
        found = read_model_folder(folder)
        if found["tokenizer_config"].is_null:
            raise TokenizerError("missing_config", str(folder))
        return Tokenizer.compile(found["tokenizer_data"], found["tokenizer_config"], strict, legacy_folder_dispatch=legacy_folder_dispatch)

    def sections(self, text: Column) -> Column:
        """The text split at added tokens, longest first; lstrip and rstrip take the white space beside them along. Without added tokens, one section."""
        if not self.added:
            return F.array(text)
        space = f"[{t.WHITE_SPACE}]*"
        one = lambda c, left, right: (space if left else "") + f"({re.escape(c)})" + (space if right else "")
        java = "|".join(one(*a) for a in self.added)
        group = "".join(f"${i + 1}" for i in range(len(self.added)))
        return t.between(text, java, lambda x: F.regexp_replace(x, java, group))

    def tokenize(self, text: Column) -> Column:
        if self.llama:
            changed = F.concat(F.lit(t.UNDERLINE), F.replace(text, F.lit(t.UNDERLINE), F.lit(" ")))
            out = self._tokenize(F.when(text == "", text).otherwise(changed))
            if not self.specials:
                return out
            drop = (F.size(out) > 1) & (F.get(out, F.lit(0)) == t.UNDERLINE) & F.get(out, F.lit(1)).isin(*self.specials)
            return F.when(drop, F.slice(out, 2, F.greatest(F.size(out) - 1, F.lit(1)))).otherwise(out)
        return self._tokenize(text)

    def _pieces(self, text: Column) -> tuple[Column, Callable[[str], str]]:
        """Pieces of all sections, with marks where a section begins and before added tokens, and what is done to a piece first."""
        steps, (split, mapped) = normalizer(self.data.normalizer), pretokenizer.late(self.data.preTokenizer)
        piece = mapped or subword._same
        if isinstance(self.model, subword.WordPiece) and self.model.basic and self.data.preTokenizer.is_null:
            # the basic stage splits at these anyway, and words repeat where whole texts do not
            split = lambda x, first: pretokenizer.blanks(x)
        if not self.added:
            for s in steps:
                text = s.column(text)
            return split(text, F.lit(True)), piece
        sections = self.sections(text)
        normal = sections
        for s in steps:
            normal = s.array(normal)
        is_added = lambda x: x.isin(*(a[0] for a in self.added))
        # a section's pieces, or the added token itself behind a mark that the model passes on
        one = lambda raw, n: F.when(is_added(raw), F.array(F.concat(F.lit(subword.RAW), raw))).otherwise(F.concat(F.array(F.lit(subword.CUT)), subword.escaped(n["x"], split(n["x"], n["i"] == 0))))
        return F.flatten(F.zip_with(sections, F.transform(normal, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), one)), piece

    def _tokenize(self, text: Column) -> Column:
        pieces, piece = self._pieces(text)
        return subword.tokenize(self.model, piece, self.model.fuse, bool(self.added))(pieces)

    def encode(self, text: Column, pair: Column | None = None, add_special_tokens: bool = True) -> Column:
        """Ids: from pieces in one step, unless tokens must be seen before (roberta's trimming, llama's first token)."""
        post = None if self.llama else post_on_ids(self.data.postProcessor, self.model.id)
        if post is not None:
            one = lambda c: (lambda pieces, piece: subword.encode(self.model, piece, bool(self.added))(pieces))(*self._pieces(c))
            return post(one(text), None if pair is None else one(pair), add_special_tokens)
        tokens = postprocessor(self.data.postProcessor)(self.tokenize(text), None if pair is None else self.tokenize(pair), add_special_tokens)
        return subword.ids(self.model)(tokens)

    def ids_within(self, text: Column, longest: int = 512) -> Column:
        """Ids without special tokens; a text with more than `longest` is an error, whose message begins with too_long."""
        return subword.within(self.encode(text, add_special_tokens=False), longest)

    def count(self, text: Column) -> Column:
        """The number of tokens of a text, without special ones."""
        if self.llama:
            return F.size(self.tokenize(text)).cast("long")
        pieces, piece = self._pieces(text)
        return subword.count_tokens(self.model, piece, marked=bool(self.added))(pieces)

    def decode(self, ids: Column, skip_special_tokens: bool = False) -> Column:
        skip = frozenset(self.specials.values()) if skip_special_tokens else frozenset()
        if self.data.decoder.type.string() == "ByteLevel" and not self.added:
            byte_of = {c: i for i, c in enumerate(t.BYTES)}
            text = F.make_valid_utf8(subword.joined_bytes(self.model, byte_of, skip)(ids).cast("string"))
        else:
            text = F.array_join(dec.decoder(self.data.decoder, tuple(a[0] for a in self.added))(subword.tokens(self.model, skip)(ids)), "")
        return dec.clean_up(text) if self.config.cleanUpTokenizationSpaces.boolean(True) else text

    def token_id(self, name: str) -> int | None:
        """The id of bos_token, eos_token, unk_token, ..."""
        token = added_token_string(self.config[name])
        return None if token is None else self.model.vocab.get(token)

    @property
    def has_chat_template(self) -> bool:
        return not self.config.chatTemplate.is_null

    def chat_text(self, messages: Column, template: chat.Choice | None = None, add_generation_prompt: bool = False, tools: list | None = None, extra: dict | None = None, fields: tuple[str, ...] | None = None) -> Column:
        """The rendered conversation; `fields` are those of messages, as chat.render takes them."""
        source = chat.select(self.config.chatTemplate, template, tools)
        context = {"add_generation_prompt": add_generation_prompt, **({"tools": tools} if tools is not None else {}), **(extra or {})}
        for name in SPECIALS:
            value = self.config[name]
            if not value.is_null:
                context[name] = added_token_string(value) if added_token_string(value) is not None else value.native()
        return chat.render(source, context, fields)(messages)

    def apply_chat_template(self, messages: Column, template: chat.Choice | None = None, add_generation_prompt: bool = True, tools: list | None = None, extra: dict | None = None, truncation: bool = False, max_length: int | None = None) -> Column:
        """Ids of the rendered conversation, without special tokens of the post-processor."""
        ids = self.encode(self.chat_text(messages, template, add_generation_prompt, tools, extra), add_special_tokens=False)
        if not truncation:
            return ids
        limits = [x for x in (max_length, self.config.modelMaxLength.integer()) if x is not None]
        return F.slice(ids, 1, min(limits)) if limits else ids
