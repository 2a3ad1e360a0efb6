"""SQL for the queries, written apart from their Spark code; both sides share only the vocabularies and fixed values."""

from __future__ import annotations

import unicodedata

from tessera.functions.text import BYTES
from tessera.operators import vocabularies

# Written out for this side, so that a wrong pattern of the engine shows.
SPACE, WHITE_SPACE, UNDERLINE = r"\p{Z}\t\n\f\r", r"\p{Z}\t\n\v\f\r\x{85}", chr(0x2581)
WORDS = r"[^\p{Z}\t\n\f\r]+"
BERT = r"[!-/:-@\[-`{-~\p{P}]|[^\p{Z}\t\n\f\r!-/:-@\[-`{-~\p{P}]+"
PUNCTUATION_RUNS = r"[!-/:-@\[-`{-~\p{P}]+|[^!-/:-@\[-`{-~\p{P}]+"
DIGIT_RUNS, DIGITS_APART = r"\p{Nd}+|[^\p{Nd}]+", r"\p{Nd}|[^\p{Nd}]+"
CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{2F800}-\x{2FA1F}"

_BYTE_LEVEL = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}\x{{E000}}]+|[{SPACE}]+"


def _s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _all(pattern: str, of: str = "text") -> str:
    return f"regexp_extract_all({of}, {_s(pattern)})"


def _rows(key: str, table: str, pieces: str, name: str = "piece") -> str:
    return f"SELECT {key}, CAST(unnest(range(len(ps))) AS BIGINT) AS pos, unnest(ps) AS {name} FROM (SELECT {key}, {pieces} AS ps FROM {table})"


def _docs(pieces: str) -> str:
    return _rows("doc_id", "documents", pieces)


def _text(e: str) -> str:
    return f"SELECT doc_id, {e} AS text FROM documents"


def _byte_split(of: str) -> str:
    """Re2 has no look-ahead: a mark goes before the last space of each run that something follows."""
    return _all(_BYTE_LEVEL, f"regexp_replace({of}, '([{SPACE}])([^{SPACE}])', '\\1\\2', 'g')")


_BYTE_MAP = "MAP {" + ", ".join(f"'{i:02X}': {_s(c)}" for i, c in enumerate(BYTES)) + "}"


def _bytes(of: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(hex(encode({of})), '..'), lambda h: {_BYTE_MAP}[h]), '')"


def _marked(pattern: str, of: str = "text", groups: str = "\\1") -> str:
    return f"list_filter(string_split(regexp_replace({of}, {_s(pattern)}, '{groups}', 'g'), ''), lambda x: x <> '')"


_WORD_LIST = f"SELECT DISTINCT word FROM (SELECT unnest({_all(WORDS, 'lower(text)')}) AS word FROM documents)"

# Subword models, of a table p(piece)


def _bpe(source: str) -> str:
    keys = ", ".join(_s(f"{a} {b}") for a, b in vocabularies.merges())
    n = len(vocabularies.merges())
    return f"""
mm AS (SELECT MAP([{keys}], range({n})) AS m),
p AS ({source}),
s(piece, l, k) AS (
  SELECT piece, string_split(piece, ''), 0 FROM p
  UNION ALL
  SELECT piece, l[:b.i - 1] || [l[b.i] || l[b.i + 1]] || l[b.i + 2:], k + 1
  FROM (SELECT piece, l, k, list_min(list_filter(list_transform(range(1, len(l)), lambda i: {{'r': m[l[i] || ' ' || l[i + 1]], 'i': i}}), lambda x: x.r IS NOT NULL)) AS b FROM s, mm)
  WHERE b IS NOT NULL),
tokens AS (SELECT piece, arg_max(l, k) AS ts FROM s GROUP BY piece)"""


def _wordpiece(source: str) -> str:
    model = vocabularies.wordpiece()
    keys, ids = ", ".join(map(_s, model.vocab)), ", ".join(map(str, model.vocab.values()))
    longest = max(len(x) for x in model.vocab)
    return f"""
v AS (SELECT MAP([{keys}], [{ids}]) AS m),
p AS ({source}),
s(piece, i, ts) AS (
  SELECT piece, CASE WHEN length(piece) > 100 THEN -1 ELSE 1 END, CASE WHEN length(piece) > 100 THEN ['[UNK]'] ELSE CAST([] AS VARCHAR[]) END FROM p
  UNION ALL
  SELECT piece, CASE WHEN k IS NULL THEN -1 ELSE i + k END, CASE WHEN k IS NULL THEN ['[UNK]'] ELSE ts || [CASE WHEN i > 1 THEN '##' ELSE '' END || substr(piece, i, k)] END
  FROM (SELECT piece, i, ts, list_max(list_filter(range(1, {longest + 1}), lambda k: i + k - 1 <= length(piece) AND m[CASE WHEN i > 1 THEN '##' ELSE '' END || substr(piece, i, k)] IS NOT NULL)) AS k
        FROM s, v WHERE i BETWEEN 1 AND length(piece))),
tokens AS (SELECT piece, ts FROM s WHERE i = -1 OR i > length(piece))"""


def _unigram(source: str) -> str:
    model = vocabularies.unigram()
    keys, scores = ", ".join(map(_s, model.scores)), ", ".join(f"{float(x)!r}::DOUBLE" for x in model.scores.values())
    longest = max(len(x) for x in model.scores)
    return f"""
p AS ({source}),
f(piece, e, best, back) AS (
  SELECT piece, 0, [CAST(0 AS DOUBLE)], [0] FROM p
  UNION ALL
  SELECT piece, e + 1, best || [-b.c], back || [b.a] FROM (
    SELECT piece, e, best, back, list_min(list_filter(list_transform(range(greatest(0, e + 1 - {longest}), e + 1), lambda a:
      {{'c': -(best[a + 1] + coalesce(MAP([{keys}], [{scores}])[substr(piece, a + 1, e + 1 - a)], CASE WHEN a = e THEN {float(model.unk_score)!r}::DOUBLE END)), 'a': a}}), lambda x: x.c IS NOT NULL)) AS b
    FROM f WHERE e < length(piece))),
g(piece, n, back, ts) AS (
  SELECT piece, e, back, CAST([] AS VARCHAR[]) FROM f WHERE e = length(piece)
  UNION ALL
  SELECT piece, back[n + 1], back, [substr(piece, back[n + 1] + 1, n - back[n + 1])] || ts FROM g WHERE n > 0),
tokens AS (SELECT piece, ts FROM g WHERE n = 0)"""


def _word_tokens(model: str, word: str = "word") -> str:
    return f"WITH RECURSIVE w AS ({_WORD_LIST}), {model}\nSELECT word, CAST(unnest(range(len(ts))) AS BIGINT) AS pos, unnest(ts) AS token FROM (SELECT {word}, ts FROM w JOIN tokens ON piece = {'word' if word == 'word' else 'x'})"


def _doc_tokens(pieces: str, model, of: str = "piece") -> str:
    """CTEs d(doc_id, pos, piece) and t(doc_id, pos, i, token)."""
    return f"""d AS ({_docs(pieces)}), {model(f'SELECT DISTINCT {of} AS piece FROM d')},
t AS (SELECT doc_id, pos, unnest(range(len(ts))) AS i, unnest(ts) AS token FROM d JOIN tokens ON tokens.piece = {of.replace('piece', 'd.piece')})"""


def _vocab(model) -> str:
    return "voc(token, id) AS (VALUES " + ", ".join(f"({_s(k)}, {i}::BIGINT)" for k, i in model.vocab.items()) + ")"


def _id_map(model) -> str:
    return f"MAP([{', '.join(map(_s, model.vocab))}], [{', '.join(map(str, model.vocab.values()))}])"


_ENCODED = "coalesce(count(id), 0) AS n_tokens, coalesce(string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos, i), '') AS ids"
_BPE_DOCS = _doc_tokens(f"list_transform({_byte_split('text')}, lambda x: {_bytes('x')})", _bpe)
_WP_DOCS = _doc_tokens(_all(BERT, "lower(text)"), _wordpiece)
_META = f"CASE WHEN starts_with(replace(lower(text), ' ', '{UNDERLINE}'), '{UNDERLINE}') THEN '' ELSE '{UNDERLINE}' END || replace(lower(text), ' ', '{UNDERLINE}')"
_UNI_DOCS = _doc_tokens(_all(f"{UNDERLINE}?[^{UNDERLINE}]+|{UNDERLINE}", _META), _unigram)

# The basic stage: patterns written out for this side
_MARKS = r"!-/:-@\[-`{-~\p{P}"
_NEVER = "('[UNK]', '[SEP]', '[PAD]', '[CLS]', '[MASK]')"
_BLANK_WORDS = _all(r"[^\t\p{Zs}]+", f"strip_accents(regexp_replace(text, '([{CJK}]\\p{{M}}*)', ' \\1 ', 'g'))")
_BASIC = f"flatten(list_transform({_BLANK_WORDS}, lambda w: CASE WHEN w IN {_NEVER} THEN [w] ELSE {_all(f'[{_MARKS}]|[^{_MARKS}]+', 'lower(w)')} END))"
_BASIC_DOCS = _doc_tokens(_BASIC, _wordpiece)

_PAIRS = f"""(SELECT conv_id, turn, {_all(WORDS)} AS a, {_all(WORDS, 'next_text')} AS b FROM (
  SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""


def _post(e: str) -> str:
    return f"SELECT conv_id, turn, array_to_string({e}, ' ') AS tokens FROM {_PAIRS}"


def _conversation(one: str, end: str = "") -> str:
    return f"SELECT conv_id, string_agg({one}, '' ORDER BY turn, role, text) || {_s(end)} AS rendered FROM conversations GROUP BY conv_id"


_CHATML = "'<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)"
_LOGITS = "logits AS (SELECT vec_id AS row_id, unnest(range(len(embedding))) AS token_id, CAST(unnest(embedding) AS DOUBLE) * 10 AS score FROM embeddings)"
_INPUTS = "inputs AS (SELECT DISTINCT vec_id AS row_id, unnest([vec_id % 64, (vec_id * 7) % 64]) AS token_id FROM embeddings)"


def _p(of: str, to: str) -> str:
    return f"{to} AS (SELECT *, exp(score - max(score) OVER w) / sum(exp(score - max_score)) OVER w AS p FROM (SELECT *, max(score) OVER (PARTITION BY row_id) AS max_score FROM {of}) WINDOW w AS (PARTITION BY row_id))"


def _top_k(of: str, k: int) -> str:
    return f"SELECT row_id, token_id, CASE WHEN rank() OVER (PARTITION BY row_id ORDER BY score DESC) <= {k} THEN score ELSE '-inf'::DOUBLE END AS score FROM {of}"


def _top_p(of: str, p: float) -> str:
    w = "(PARTITION BY row_id ORDER BY score DESC, token_id ROWS UNBOUNDED PRECEDING)"
    return f"SELECT row_id, token_id, CASE WHEN sum(p) OVER {w} - p <= {p} OR row_number() OVER {w} <= 1 THEN score ELSE '-inf'::DOUBLE END AS score FROM {of}"


def _min_p(of: str, p: float) -> str:
    return f"SELECT row_id, token_id, CASE WHEN p >= {p} * max(p) OVER (PARTITION BY row_id) OR row_number() OVER (PARTITION BY row_id ORDER BY score DESC, token_id) <= 1 THEN score ELSE '-inf'::DOUBLE END AS score FROM {of}"


def _repetition(of: str, x: float) -> str:
    return f"SELECT l.row_id, l.token_id, CASE WHEN i.row_id IS NULL THEN score WHEN score < 0 THEN score * {x} ELSE score / {x} END AS score FROM {of} l LEFT JOIN inputs i ON l.row_id = i.row_id AND l.token_id = i.token_id"


_KEPT = "SELECT row_id, token_id, score > '-inf'::DOUBLE AS kept FROM"
_CLEAN = "text"
for _old, _new in ((" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ' ", "'"), (" n't", "n't"), (" 'm", "'m"), (" 's", "'s"), (" 've", "'ve"), (" 're", "'re")):
    _CLEAN = f"replace({_CLEAN}, {_s(_old)}, {_s(_new)})"
_CLEANED = r"regexp_replace(text, '\r\n|[\t\n\r]', ' ', 'g')"
_BERT_NORM = f"regexp_replace({_CLEANED}, '([{CJK}]\\p{{M}}*)', ' \\1 ', 'g')"
_SPLIT = f"(SELECT doc_id, {_all(WORDS)} AS ts FROM documents)"
_GLOBS = r"regexp_full_match(url, '(?s).*\.html') OR regexp_full_match(url, '(?s)http://blog\..*/en/.*')"


def _joined(e: str) -> str:
    return f"SELECT doc_id, array_to_string({e}, '') AS text FROM {_SPLIT}"


_CHARSMAP = "regexp_replace(regexp_replace(text, '[\\x01-\\x08\\x0B\\x0E-\\x1F\\x7F\\x{8F}\\x{9F}]', '', 'g'), '[\\x09\\x0A\\x0C\\x0D\\x{1680}\\x{200B}-\\x{200F}\\x{2028}\\x{2029}\\x{2581}\\x{FEFF}\\x{FFFD}]', ' ', 'g')"


def _decomposed(name: str) -> str:
    """Texts by characters, each joined with its decomposition, and marks ordered by class within what begins with a class of 0."""
    changed = [(c, unicodedata.normalize(name, c)) for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x2FA1E)))]
    table = ", ".join(f"({ord(c)}, {_s(d)})" for c, d in changed if c != d and not 0xAC00 <= ord(c) < 0xD7A4)
    marks = ", ".join(f"({c}, {k})" for c in range(0x300, 0x1E94B) if (k := unicodedata.combining(chr(c))))
    return f"""dec(c, d) AS (VALUES {table}), ccc(c, k) AS (VALUES {marks}),
ch AS (SELECT doc_id, i, x FROM (SELECT doc_id, unnest(string_split(text, '')) AS x, unnest(range(length(text))) AS i FROM documents) WHERE x <> ''),
de AS (SELECT doc_id, i, j, y FROM (SELECT doc_id, i, unnest(string_split(coalesce(d, x), '')) AS y, unnest(range(length(coalesce(d, x)))) AS j FROM ch LEFT JOIN dec ON c = unicode(x))),
gr AS (SELECT doc_id, i, j, y, coalesce(k, 0) AS k, sum(CASE WHEN k IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i, j) AS g FROM de LEFT JOIN ccc ON c = unicode(y)),
form AS (SELECT doc_id, string_agg(y, '' ORDER BY g, k, i, j) AS form FROM gr GROUP BY doc_id)"""


def _form(name: str, form: str = "form") -> str:
    return f"WITH {_decomposed(name)} SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce({form}, '') END AS text FROM documents LEFT JOIN form USING (doc_id)"


# DuckDB's JSON functions in place of VARIANTs; numbers keep their text
_SETTINGS = """k AS (SELECT o_orderkey, [CAST(o_custkey AS VARCHAR), CAST(floor(o_totalprice) AS BIGINT) || '.25', '"' || o_orderpriority || '"', 'true', 'null', '"T"',
  '["<s>",' || o_custkey || ']', '[' || o_custkey || ',"<s>"]', '{"a":1,"b":[1,2.5,"x,]"]}', '"0"', '1'] AS kinds, o_orderstatus, o_custkey FROM orders),
s AS (SELECT o_orderkey, o_orderstatus, o_custkey, kinds[o_orderkey % 11 + 1] AS a, kinds[o_orderkey // 11 % 11 + 1] AS b, o_orderkey % 11 AS i, o_orderkey // 11 % 11 AS j FROM k)"""


SQL = {
    "pre_whitespace": _docs(_all(WORDS)),
    "pre_bert": _docs(_all(BERT)),
    "pre_punctuation": _docs(_all(PUNCTUATION_RUNS)),
    "pre_digits": _docs(_all(DIGIT_RUNS)),
    "pre_digits_individual": _docs(_all(DIGITS_APART)),
    "pre_bytelevel": _docs(f"list_transform({_byte_split('text')}, lambda x: {_bytes('x')})"),
    "pre_bytelevel_prefix": _docs(f"list_transform({_byte_split('text')}, lambda x: CASE WHEN starts_with(x, ' ') THEN '' ELSE {_s(BYTES[32])} END || {_bytes('x')})"),
    "pre_bytelevel_noregex": _docs(f"[{_bytes('text')}]"),
    "pre_metaspace": _docs(_all(f"{UNDERLINE}?[^{UNDERLINE}]+|{UNDERLINE}", _META.replace("lower(text)", "text"))),
    "pre_split_string": _docs(_marked(r"(\. )")),
    "pre_split_regex": _docs(_marked("([0-9]+)")),
    "pre_sequence": _docs(f"flatten(list_transform({_all(WORDS)}, lambda x: {_all(DIGITS_APART, 'x')}))"),
    "split_removed": _rows("page_id", "pages", "list_filter(string_split(url, '/'), lambda x: x <> '')"),
    "split_isolated": _rows("page_id", "pages", _all("/|[^/]+", "url")),
    "split_merged_with_previous": _rows("page_id", "pages", _all("[^/]*/|[^/]+", "url")),
    "split_merged_with_next": _rows("page_id", "pages", _all("/[^/]*|[^/]+", "url")),
    "norm_lowercase": _text("lower(text)"),
    "norm_prepend": _text(f"'{UNDERLINE}' || text"),
    "norm_replace_literal": _text(f"replace(text, ' ', '{UNDERLINE}')"),
    "norm_replace_regex": _text("regexp_replace(text, '[0-9]+', '0', 'g')"),
    "norm_strip": _text(f"regexp_replace(regexp_replace(text, '^[{WHITE_SPACE}]+', ''), '[{WHITE_SPACE}]+$', '')"),
    "norm_bert": _text(f"lower(strip_accents({_BERT_NORM}))"),
    "norm_bert_cased": _text(_BERT_NORM),
    "norm_nfc": _text("nfc_normalize(text)"),
    "norm_nfd": _form("NFD"),
    "norm_nfkd": _form("NFKD"),
    "norm_nfkc": _form("NFKD", "nfc_normalize(form)"),
    "norm_strip_accents": _form("NFKD", "nfc_normalize(form)"),
    # no text holds a fullwidth tilde
    "norm_precompiled": _form("NFKD", "nfc_normalize(form)").replace("FROM documents) WHERE x", f"FROM (SELECT doc_id, {_CHARSMAP} AS text FROM documents)) WHERE x"),
    "norm_sequence": _text("'>' || replace(lower(text), '.', ' .')"),
    "bpe_merge": _word_tokens(_bpe(f"SELECT {_bytes('word')} AS piece FROM w")).replace("SELECT word, ts FROM w JOIN tokens ON piece = word", f"SELECT word, ts FROM w JOIN tokens ON piece = {_bytes('word')}"),
    "wp_wordpiece": _word_tokens(_wordpiece("SELECT word AS piece FROM w")),
    "uni_tokenize": _word_tokens(_unigram("SELECT word AS piece FROM w")),
    "bpe_byte_encode": _rows("word", f"({_WORD_LIST})", f"list_transform({_byte_split('word')}, lambda x: {_bytes('x')})", "token"),
    "bpe_hexa_encode": _rows("word", f"({_WORD_LIST})", "list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda h: '<0x' || h || '>')", "token"),
    "bpe_encode": f"WITH RECURSIVE {_BPE_DOCS}, {_vocab(vocabularies.bpe())}\nSELECT documents.doc_id, {_ENCODED} FROM documents LEFT JOIN t ON t.doc_id = documents.doc_id LEFT JOIN voc USING (token) GROUP BY documents.doc_id",
    "wp_encode": f"WITH RECURSIVE {_WP_DOCS}, {_vocab(vocabularies.wordpiece())}\nSELECT documents.doc_id, count(id) + 2 AS n_tokens, concat_ws(' ', '2', string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos, i), '3') AS ids FROM documents LEFT JOIN t ON t.doc_id = documents.doc_id LEFT JOIN voc USING (token) GROUP BY documents.doc_id",
    "wp_basic": _rows("doc_id", "documents", _BASIC, "token"),
    "wp_tokenize": f"WITH RECURSIVE {_BASIC_DOCS}\nSELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, i) - 1 AS pos, token FROM t",
    "wp_ids": f"WITH RECURSIVE {_BASIC_DOCS}, {_vocab(vocabularies.wordpiece())}\nSELECT doc_id, n_tokens, n_tokens > 512 AS too_long, CASE WHEN n_tokens <= 512 THEN ids END AS ids FROM (SELECT documents.doc_id, {_ENCODED} FROM documents LEFT JOIN t ON t.doc_id = documents.doc_id LEFT JOIN voc USING (token) GROUP BY documents.doc_id)",
    "uni_encode": f"""WITH RECURSIVE {_UNI_DOCS},
x AS (SELECT doc_id, pos, i, coalesce({_id_map(vocabularies.unigram())}[token], 0) AS id FROM t),
y AS (SELECT *, lag(id) OVER (PARTITION BY doc_id ORDER BY pos, i) AS last FROM x)
SELECT doc_id, {_ENCODED} FROM y WHERE NOT (id = 0 AND last IS NOT NULL AND last = 0) GROUP BY doc_id""",
    "tokens_by_language": f"""WITH RECURSIVE {_BPE_DOCS}, n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id)
SELECT lang, count(*) AS n_docs, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_tokens, max(coalesce(n, 0)) AS longest FROM documents LEFT JOIN n USING (doc_id) GROUP BY lang""",
    "decode_bytelevel": _text("text"),
    "decode_wordpiece": _joined("list_transform(ts, lambda x, i: CASE WHEN i = 1 THEN x WHEN starts_with(x, 'th') THEN substr(x, 3) ELSE ' ' || x END)"),
    "decode_metaspace": f"SELECT doc_id, array_to_string(ts, ' ') AS text FROM {_SPLIT}",
    "decode_strip": _joined("list_transform(ts, lambda x: ' ' || x)"),
    "decode_replace": _joined("list_transform(ts, lambda x: replace(x, 'e', ' '))"),
    "decode_fuse": _joined("ts"),
    "decode_byte_fallback": _joined("ts[:coalesce(list_max(list_filter(range(1, len(ts) + 1), lambda i: NOT starts_with(ts[i], 't'))), 0)]"),
    "decode_sequence": _joined("list_transform(ts, lambda x: replace(x, 'a', '_'))"),
    "wp_untokenize": f"WITH RECURSIVE {_WP_DOCS}\nSELECT documents.doc_id, regexp_replace(replace(' ' || coalesce(string_agg(token, ' ' ORDER BY pos, i), ''), ' ##', ''), '^ ', '') AS text FROM documents LEFT JOIN t ON t.doc_id = documents.doc_id GROUP BY documents.doc_id",
    "tok_cleanup": f"SELECT doc_id, {_CLEAN} AS text FROM (SELECT doc_id, array_to_string({_all(BERT)}, ' ') AS text FROM documents)",
    "tok_added_split": _docs(_marked(r"\s*(the)|(and)\s*|(\.)", groups=r"\1\2\3")),
    "tok_fuse_unknown": f"""WITH RECURSIVE {_WP_DOCS}, x AS (SELECT doc_id, token, lag(token) OVER (PARTITION BY doc_id ORDER BY pos, i) AS last FROM t)
SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (token = '[UNK]') AS n_unk FROM x WHERE NOT (token = '[UNK]' AND coalesce(last, '') = '[UNK]') GROUP BY doc_id""",
    "tok_ids": f"WITH w AS ({_WORD_LIST}), {_vocab(vocabularies.wordpiece())}\nSELECT word AS token, coalesce(id, 1) AS id FROM w LEFT JOIN voc ON token = word",
    "tok_unk_rate": f"WITH RECURSIVE {_WP_DOCS}\nSELECT lang, count(*) AS n_tokens, count(*) FILTER (token = '[UNK]') AS n_unk FROM t JOIN documents USING (doc_id) GROUP BY lang",
    "post_bert_single": _post("['[CLS]'] || a || ['[SEP]']"),
    "post_bert_pair": _post("['[CLS]'] || a || ['[SEP]'] || CASE WHEN len(b) > 0 THEN b || ['[SEP]'] ELSE CAST([] AS VARCHAR[]) END"),
    "post_roberta_pair": _post("['<s>'] || list_transform(a, lambda x: ' ' || x) || ['</s>'] || CASE WHEN len(b) > 0 THEN ['</s>'] || b || ['</s>'] ELSE CAST([] AS VARCHAR[]) END"),
    "post_template": _post("['<s>'] || a || ['</s>'] || b || ['</s>']"),
    "post_sequence": _post("['<s>'] || a || ['</s>']"),
    "chat_chatml": _conversation(_CHATML),
    "chat_render": _conversation(_CHATML),
    "chat_generation_prompt": _conversation(_CHATML, "<|im_start|>assistant\n"),
    "chat_llama_inst": _conversation("CASE role WHEN 'user' THEN '<s>[INST] ' || trim(text) || ' [/INST]' WHEN 'system' THEN '<<SYS>>' || chr(10) || trim(text) || chr(10) || '<</SYS>>' || chr(10) || chr(10) ELSE ' ' || trim(text) || ' </s>' END"),
    "chat_truncate": "WITH RECURSIVE c AS (" + _conversation(_CHATML) + "), "
    + _doc_tokens(f"list_transform({_byte_split('rendered')}, lambda x: {_bytes('x')})", _bpe).replace("SELECT doc_id, list_transform", "SELECT conv_id AS doc_id, list_transform").replace("FROM documents", "FROM c")
    + " SELECT doc_id AS conv_id, least(count(*), 200) AS n_tokens FROM t GROUP BY doc_id",
    "logit_temperature": f"WITH {_LOGITS} SELECT row_id, token_id, round(score / 0.7, 6) AS score FROM logits",
    "logit_topk": f"WITH {_LOGITS} {_KEPT} ({_top_k('logits', 5)})",
    "logit_topp": f"WITH {_LOGITS}, {_p('logits', 'x')} {_KEPT} ({_top_p('x', 0.9)})",
    "logit_minp": f"WITH {_LOGITS}, {_p('logits', 'x')} {_KEPT} ({_min_p('x', 0.1)})",
    "logit_repetition": f"WITH {_LOGITS}, {_INPUTS} SELECT row_id, token_id, round(score, 6) AS score FROM ({_repetition('logits', 1.3)})",
    "logit_custom": f"WITH {_LOGITS}, {_p('logits', 'x')} SELECT row_id, token_id, p >= 0.02 OR row_number() OVER (PARTITION BY row_id ORDER BY score DESC, token_id) = 1 AS kept FROM x",
    "wp_table_function": "WITH RECURSIVE documents AS (SELECT p_partkey AS doc_id, concat_ws(' ', p_name, p_type) AS text FROM part), " + _doc_tokens(_all(WORDS, "lower(text)"), _wordpiece) + "\nSELECT doc_id AS p_partkey, row_number() OVER (PARTITION BY doc_id ORDER BY pos, i) - 1 AS pos, token FROM t",
    "logit_softmax": f"WITH {_LOGITS}, {_p('logits', 'x')} SELECT row_id, token_id, round(p, 6) AS p FROM x",
    "logit_greedy": f"WITH {_LOGITS} SELECT row_id, arg_max(token_id, {{'s': score, 't': -token_id}}) AS token_id FROM logits GROUP BY row_id",
    "logit_plan": f"WITH {_LOGITS}, {_INPUTS}, a AS ({_repetition('logits', 1.3)}), b AS (SELECT row_id, token_id, score / 0.7 AS score FROM a), c AS ({_top_k('b', 20)}), {_p('c', 'd')}, e AS ({_top_p('d', 0.9)}), {_p('e', 'f')} {_KEPT} ({_min_p('f', 0.02)})",
    "logit_sample_u": f"WITH {_LOGITS}, {_p('logits', 'x')}, y AS (SELECT row_id, token_id, sum(p) OVER (PARTITION BY row_id ORDER BY token_id ROWS UNBOUNDED PRECEDING) AS c FROM x) SELECT row_id, coalesce(min(token_id) FILTER (c >= (row_id * 37 % 101 + 0.5) / 101), min(token_id)) AS token_id FROM y GROUP BY row_id",
    "gen_mode": """SELECT *, CASE WHEN k > 1 AND NOT sample AND coalesce(alpha, 0) > 0 THEN 'contrastive_search' WHEN beams = 1 AND beam_groups = 1 THEN CASE WHEN sample THEN 'sample' ELSE 'greedy' END
WHEN beams >= 2 AND beam_groups = 1 AND NOT sample THEN 'beam' WHEN beams >= 2 AND beam_groups >= 2 THEN 'group_beam' ELSE 'unsupported' END AS mode
FROM (SELECT o_orderkey, CAST(1 + o_orderkey % 2 AS INT) AS beams, CAST(1 + o_orderkey // 2 % 2 AS INT) AS beam_groups, o_orderkey // 4 % 2 = 1 AS sample, CASE WHEN o_orderkey // 8 % 2 = 1 THEN 50 ELSE 1 END AS k,
  CASE o_orderkey // 16 % 3 WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN o_totalprice / 1e6 END AS alpha FROM orders)""",
    "gen_loop_table": f"""WITH RECURSIVE {_LOGITS}, best AS (SELECT row_id AS token_id, arg_max(token_id, {{'s': score, 't': -token_id}}) AS next_id FROM logits WHERE row_id < 64 GROUP BY row_id),
g(seq_id, step, token_id) AS (SELECT vec_id, 0::BIGINT, vec_id % 64 FROM embeddings UNION ALL SELECT seq_id, step + 1, next_id FROM g JOIN best USING (token_id) WHERE step < 8) SELECT * FROM g""",
    "gen_loop_end": f"""WITH RECURSIVE {_LOGITS}, best AS (SELECT row_id AS token_id, arg_max(token_id, {{'s': score, 't': -token_id}}) AS next_id FROM logits GROUP BY row_id),
g(seq_id, step, token_id) AS (SELECT vec_id, 0::BIGINT, vec_id % 64 FROM embeddings UNION ALL SELECT seq_id, step + 1, next_id FROM g JOIN best USING (token_id) WHERE step < 50 AND next_id <> 7) SELECT * FROM g""",
    "lm_pad": """SELECT item_id, array_to_string(list_transform(range(1, greatest(512, n) + 1), lambda i: CASE WHEN i <= n THEN unicode(cs[i]) ELSE 0 END), ' ') AS ids,
array_to_string(list_transform(range(1, greatest(512, n) + 1), lambda i: CASE WHEN i <= n THEN 1 ELSE 0 END), ' ') AS mask FROM (SELECT item_id, string_split(text, '') AS cs, length(text) AS n FROM benchmark)""",
    "lm_default_gen": "SELECT doc_id, name, 2048::BIGINT AS max_new_tokens, contains(lower(name), 'gpt') AS do_sample, 50::BIGINT AS top_k FROM (SELECT doc_id, source || ['-GPT-neo', '/my-gpt2', '-llama'][doc_id % 3 + 1] AS name FROM documents)",
    "cli_format": "SELECT item_id, replace(text, '.', chr(10)) AS text FROM benchmark",
    "trie_prefix_join": f"SELECT word, entry FROM ({_WORD_LIST}) JOIN (VALUES " + ", ".join(f"({_s(g)})" for g in vocabularies.GROUPS) + ") v(entry) ON starts_with(word, entry)",
    "map_merge": "SELECT coalesce(CAST(r_regionkey AS BIGINT), CAST(n_nationkey AS BIGINT)) AS key, coalesce(r_name, n_name) AS value FROM nation FULL JOIN region ON n_nationkey = r_regionkey",
    "file_glob": f"SELECT page_id, url FROM pages WHERE {_GLOBS}",
    "file_sha256": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "file_valid_hash": "SELECT doc_id, regexp_full_match(h, '[0-9a-f]{40}') AS is_commit, regexp_full_match(h, '[0-9a-f]{64}') AS is_sha256 FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN sha256(text) WHEN 1 THEN substr(sha256(text), 1, 40) ELSE upper(sha256(text)) END AS h FROM documents)",
    "download_decision": """SELECT doc_id, CASE WHEN k = 0 OR (k < 4 AND c = reverse(c)) THEN 'keep_commit' WHEN k = 1 THEN 'keep_etag' WHEN k = 3 OR h = reverse(h) THEN 'keep_hash' ELSE 'download' END AS decision
FROM (SELECT doc_id, doc_id % 5 AS k, sha256(text) AS h, substr(sha256(text), 1, 40) AS c FROM documents)""",
    "progress_emit": """WITH x AS (SELECT user_id, event_id, ts, CAST(floor(sum(floor(greatest(coalesce(value, 0), 0))) OVER (PARTITION BY user_id ORDER BY ts, event_id) / 50) AS BIGINT) AS completed FROM events),
y AS (SELECT *, completed - coalesce(lag(completed) OVER (PARTITION BY user_id ORDER BY ts, completed), 0) AS delta FROM x) SELECT user_id, event_id, completed, delta FROM y WHERE delta <> 0""",
    "uni_lookup": f"WITH w AS ({_WORD_LIST}), {_vocab(vocabularies.unigram())}\nSELECT word AS token, coalesce(id, 0) AS id FROM w LEFT JOIN voc ON token = word",
    # the transfers' states as rows of a recursion
    "progress_reports": """WITH RECURSIVE c AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS ts, CAST(floor(sum(floor(greatest(coalesce(value, 0), 0))) OVER w / 50) AS BIGINT) AS completed,
  lead(event_id) OVER w IS NULL AS complete, row_number() OVER w AS place FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT user_id, ts, completed, complete, CASE WHEN total > 0 THEN least(greatest(completed / total, 0), 1) WHEN complete THEN 1 ELSE 0 END AS share, row_number() OVER (PARTITION BY user_id ORDER BY ts, completed, complete) AS n
  FROM (SELECT *, max(completed) OVER (PARTITION BY user_id) + place AS total FROM c)),
g(user_id, n, ts, high, since, stalled, last, share, speed, report, ended) AS (
  SELECT user_id, 0::BIGINT, 0::DOUBLE, 0::BIGINT, min(ts), NULL::DOUBLE, 0::DOUBLE, 0::DOUBLE, NULL::DOUBLE, false, false FROM r GROUP BY user_id
  UNION ALL
  SELECT user_id, n, ts, CASE kind WHEN 'growth' THEN completed ELSE high END, CASE kind WHEN 'growth' THEN ts ELSE since END,
    CASE kind WHEN 'growth' THEN NULL WHEN 'stall' THEN ts ELSE stalled END, CASE WHEN kind IN ('growth', 'news', 'stall') THEN share ELSE last END, share,
    CASE WHEN kind = 'growth' THEN CASE WHEN ts > since THEN (completed - high) / (ts - since) ELSE 0 END END,
    kind IN ('growth', 'news', 'stall'), ended
  FROM (SELECT g.user_id, r.n, r.ts, r.completed, r.share, g.high, g.since, g.stalled, g.last, g.ended OR r.complete AS ended,
    CASE WHEN g.ended OR (r.share >= 1 AND NOT r.complete) THEN 'held' WHEN r.completed > g.high THEN 'growth' WHEN r.complete OR r.completed < g.high OR abs(r.share - g.last) >= 0.001 THEN 'news'
      WHEN g.high > 0 AND r.ts - coalesce(g.stalled, g.since) >= 1 THEN 'stall' ELSE 'quiet' END AS kind
    FROM g JOIN r ON r.user_id = g.user_id AND r.n = g.n + 1))
SELECT user_id, ts, round(share, 6) AS fraction, round(speed, 6) AS speed FROM g WHERE report""",
    "cfg_get": f"""WITH {_SETTINGS} SELECT o_orderkey, '"' || o_orderstatus || '"' AS own, a AS snake, b AS camel, b AS placed, CAST(NULL AS VARCHAR) AS beyond, CAST(NULL AS VARCHAR) AS no_camel,
  CAST(json_extract(CAST(a AS JSON), '$.b[2]') AS VARCHAR) AS deep, true AS none, true AS missing FROM s""",
    "cfg_coerce": f"""WITH {_SETTINGS}, t AS (SELECT *, json_type(CAST(a AS JSON)) AS type, json_extract_string(CAST(a AS JSON), '$') AS x FROM s)
SELECT o_orderkey, CASE WHEN type = 'NULL' THEN 'null' WHEN type = 'VARCHAR' THEN 'string' WHEN type IN ('UBIGINT', 'BIGINT') THEN 'integer' WHEN type = 'BOOLEAN' THEN 'boolean' WHEN type = 'ARRAY' THEN 'array' WHEN type = 'OBJECT' THEN 'dictionary' ELSE 'floating' END AS kind,
  CASE type WHEN 'VARCHAR' THEN x END AS string, CASE WHEN type IN ('UBIGINT', 'BIGINT') THEN CAST(x AS BIGINT) ELSE -1 END AS integer,
  CASE WHEN type = 'BOOLEAN' THEN x = 'true' WHEN type IN ('UBIGINT', 'BIGINT') THEN CAST(x AS BIGINT) = 1 WHEN type = 'VARCHAR' AND lower(x) IN ('true', 't', '1') THEN true WHEN type = 'VARCHAR' AND lower(x) IN ('false', 'f', '0') THEN false END AS boolean,
  CASE WHEN type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(CAST(CAST(x AS DOUBLE) AS FLOAT) AS DOUBLE) END AS floating,
  CASE type WHEN 'ARRAY' THEN CAST(json_array_length(CAST(a AS JSON)) AS BIGINT) END AS items, CASE type WHEN 'OBJECT' THEN array_to_string(json_keys(CAST(a AS JSON)), ',') END AS keys FROM t""",
    # the eleven kinds of entry, by pairs: which are equal whatever the order is
    "cfg_equals": f"""WITH {_SETTINGS}, e AS (SELECT *, CASE WHEN i = j THEN true
  WHEN least(i, j) = 0 AND greatest(i, j) = 3 THEN o_custkey = 1 WHEN least(i, j) = 0 AND greatest(i, j) = 10 THEN o_custkey = 1
  WHEN least(i, j) = 0 AND greatest(i, j) = 1 THEN CAST(o_custkey AS FLOAT) = CAST(json_extract_string(CAST(CASE i WHEN 1 THEN a ELSE b END AS JSON), '$') AS FLOAT)
  WHEN least(i, j) = 1 AND greatest(i, j) = 10 THEN CAST(json_extract_string(CAST(CASE i WHEN 1 THEN a ELSE b END AS JSON), '$') AS FLOAT) = 1
  WHEN least(i, j) = 3 AND greatest(i, j) IN (5, 10) THEN true ELSE false END AS equal FROM s)
SELECT o_orderkey, equal, equal AS turned, a = b AS same_hash FROM e""",
    "cfg_token": f"WITH {_SETTINGS} SELECT o_orderkey, CASE WHEN i IN (6, 7) THEN o_custkey END AS id, CASE WHEN i IN (6, 7) THEN '<s>' END AS token FROM s",
    "cfg_entries": """SELECT event_id, 'event_type' AS key, '"' || event_type || '"' AS value FROM events WHERE props IS NOT NULL OR event_type IS NOT NULL
UNION ALL SELECT event_id, 'k' AS key, coalesce(CAST(json_extract(CAST(props AS JSON), '$.k') AS VARCHAR), '"old"') AS value FROM events""",
    "str_binary": "SELECT page_id, replace(url, 'e', chr(233)) = replace(url, 'e', 'e' || chr(769)) AS equal, replace(url, 'e', chr(233)) < replace(url, 'e', 'e' || chr(769)) AS less, starts_with('e' || chr(769) || url, 'e') AS starts, ends_with(url || 'e' || chr(769), chr(233)) AS ends, chr(233) || lower(url) AS lowered, array_to_string(list_transform(range(3, 7), lambda i: substr(replace(url, 't', 'e' || chr(769)), i, 1)), '') AS sliced FROM pages",
    "file_local_path": "SELECT doc_id, '/models/' || CASE doc_id % 3 WHEN 0 THEN 'models' WHEN 1 THEN 'datasets' ELSE 'spaces' END || '/' || concat_ws('/', source, lang) AS path FROM documents",
    "file_resolve_url": "SELECT doc_id, 'https://example.com/' || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'datasets/' ELSE 'spaces/' END || concat_ws('/', source, lang) || '/resolve/refs%2Fpr%2F' || doc_id || '/config.json' AS url FROM documents",
    "file_clean_etag": "SELECT doc_id, sha256(text) AS etag FROM documents",
    "split_captures": """WITH x AS (SELECT page_id, regexp_split_to_array(url, '(:)//|[/?]([a-z]+)[=/]|[#&]') AS gaps, regexp_extract_all(url, '(:)//|[/?]([a-z]+)[=/]|[#&]', 0) AS whole,
  regexp_extract_all(url, '(:)//|[/?]([a-z]+)[=/]|[#&]', 1) AS one, regexp_extract_all(url, '(:)//|[/?]([a-z]+)[=/]|[#&]', 2) AS two FROM pages),
y AS (SELECT page_id, unnest(list_filter(flatten(list_transform(range(1, len(gaps) + 1), lambda i: [gaps[i], CASE WHEN two[i] <> '' THEN two[i] WHEN one[i] <> '' THEN one[i] ELSE coalesce(whole[i], '') END])), lambda p: p <> '')) AS piece,
  unnest(range(len(list_filter(flatten(list_transform(range(1, len(gaps) + 1), lambda i: [gaps[i], coalesce(whole[i], '')])), lambda p: p <> '')))) AS pos FROM x)
SELECT page_id, pos, piece FROM y""",
    "split_ranges": """SELECT page_id, b AS start, b + length(regexp_extract(substr(url, b + 1), '^/+')) AS "end"
FROM (SELECT page_id, url, unnest(list_filter(range(0, length(url)), lambda i: substr(url, i + 1, 1) = '/' AND (i = 0 OR substr(url, i, 1) <> '/'))) AS b FROM pages)""",
}
