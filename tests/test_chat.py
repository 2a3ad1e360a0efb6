"""Chat templates: the language, and that expressions of the JVM write what the interpreter writes."""

import pytest
from pyspark.sql import functions as F

from tessera.plans import chat, chat_columns

CONVERSATIONS = [
    [("system", " Be brief. "), ("user", "Hi\n"), ("assistant", "<think>hm</think>\n\nHello"), ("user", "Bye")],
    [("user", "Hi"), ("assistant", "A"), ("user", "B")],
    [("user", "a"), ("user", "b"), ("tool", "x"), ("tool", "y"), ("assistant", "c")],
    [("system", "only")],
    [("user", ""), ("assistant", None)],
    [],
]
TEMPLATES = {
    "chatml": "{% for m in messages %}{{ '<|im_start|>' + m['role'] + '\n' + m['content'] | trim + '<|im_end|>' + '\n' }}{% endfor %}{% if add_generation_prompt %}{{ '<|im_start|>assistant\n' }}{% endif %}",
    "default system": "{%- if messages and messages[0]['role'] == 'system' %}{{- messages[0]['content'] }}{%- else %}{{- 'none' }}{%- endif %}{%- for m in messages %}{%- if (m.role == 'user') or (m.role == 'system' and not loop.first) %}{{- '<' ~ m.role ~ '>' ~ m.content }}{%- elif m.role == 'assistant' %}{%- set content = m.content %}{%- if content is string and '</think>' in content %}{%- set content = content.split('</think>')[-1].lstrip('\\n') if false else content.split('</think>')[-1] | trim %}{%- endif %}{{- '[' ~ content ~ ']' }}{%- endif %}{%- endfor %}",
    "namespace": "{% set ns = namespace(seen=false, last='', n=0) %}{% for m in messages %}{% if m.role == 'user' %}{% set ns.seen = true %}{% set ns.n = ns.n + 1 %}{{ ns.n }}{{ ns.last }}{% endif %}{% set ns.last = m.role %}{% endfor %}{{ ns.seen }} {{ ns.n }} {{ ns.last }}{% if ns.n > 1 %} many{% endif %}",
    "filtered": "{% for m in messages if m.role != 'system' %}{{ loop.index }}/{{ loop.length }}{{ m.role }}{% if loop.last %}.{% else %},{% endif %}{% else %}nobody{% endfor %}",
    "neighbours": "{% for m in messages %}{% if m.role == 'tool' %}{% if loop.first or loop.previtem.role != 'tool' %}<tools>{% endif %}{{ m.content }}{% if loop.last or loop.nextitem.role != 'tool' %}</tools>{% endif %}{% else %}{{ loop.index0 }}{{ m.role | upper }}{% endif %}{% endfor %}",
    "macro": "{% macro show(m, mark='*', after='') %}{{ mark }}{{ m.role }}:{{ m.content }}{{ after }}{% endmacro %}{% for m in messages %}{{ show(m) }}{{ show(m, '-', after='!') | trim }}{% endfor %}",
    "slices": "{% set rest = messages[1:] %}{% for m in rest %}{{ m.content }}{% endfor %}|{{ rest | length }}|{% for m in messages[::-1] %}{{ m.role }}{% endfor %}|{% for m in messages[:-1] %}{{ m.role[:2] }}{% endfor %}|{{ (messages | last).role if messages else '-' }}",
    "tools": "{% if tools is defined and tools %}{% for t in tools %}{{ t | tojson }}{{ loop.index }}{% endfor %}{% endif %}{% for k, v in extra.items() %}{{ k }}={{ v }};{% endfor %}{% if date is not defined %}{% set date = 'today' %}{% endif %}{{ date }}{% for m in messages %}{% if m.role in ['user', 'tool'] %}{{ bos_token }}{% endif %}{{ 'even' if loop.index0 % 2 == 0 else 'odd' }}{% endfor %}",
    "white space": "{% for message in messages %}\n    {% if message['role'] == 'user' %}\n{{ message['content'] }}\n    {% endif %}\n{% endfor %}\n{% if add_generation_prompt %}\nassistant\n{% endif %}\n",
    "words in texts": "{{ 'is not none, true ~ false' }}{% for m in messages %}{{ 'if x' if m.role == 'user' and 'a' not in m.content else \"is defined\" }}{% endfor %}",
    "methods": "{% for m in messages %}{% if m.content is defined and m.content is not none %}{{ m.content.strip().upper() }}{{ m.content.startswith('H') }}{{ m.content | replace('i', 'o') if false else m.content.replace('i', 'o') }}{{ m.content | length }}{% endif %}{% endfor %}",
}
CONTEXT = {"add_generation_prompt": True, "tools": [{"type": "f", "é": [1]}], "extra": {"a": 1, "b": "x"}, "bos_token": "<s>"}


def rows(spark):
    data = [(i, [{"role": r, "content": c} for r, c in ms]) for i, ms in enumerate(CONVERSATIONS)]
    return spark.createDataFrame([*data, (99, None)], "i int, messages array<struct<role: string, content: string>>")


def interpreted(source, ms):
    # an undefined text in a sum is nothing in expressions; the interpreter has no such sum
    return chat.Template(source).render({**CONTEXT, "messages": [{"role": r, "content": c} for r, c in ms]})


@pytest.mark.parametrize("name", TEMPLATES)
def test_expressions_write_what_the_interpreter_writes(spark, name):
    source = TEMPLATES[name]
    df = rows(spark).select("i", chat.render(source, CONTEXT, ("role", "content"))(F.col("messages")).alias("text"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    found = {r.i: r.text for r in df.collect()}
    assert found.pop(99) is None
    for i, ms in enumerate(CONVERSATIONS):
        whole = [(r, c if c is not None or name in ("methods", "filtered") else "") for r, c in ms]
        expected = interpreted(source, whole)
        if name == "methods" and any(c is None for _, c in ms):
            expected = interpreted(source, ms)
        assert found[i] == expected, (name, i)


def test_white_space_of_blocks():
    assert chat.Template(TEMPLATES["white space"]).render({"messages": [{"role": "user", "content": "Hi"}], "add_generation_prompt": True}) == "Hi\nassistant\n"


def test_errors_are_raised_where_they_stand(spark):
    source = "{% for m in messages %}{% if (m.role == 'user') != (loop.index0 % 2 == 0) %}{{ raise_exception('roles must alternate') }}{% endif %}{{ m.role }}{% endfor %}"
    df = spark.createDataFrame([([("user", "a"), ("assistant", "b")],)], "messages array<struct<role: string, content: string>>")
    assert df.select(chat.render(source, {})(F.col("messages"))).head()[0] == "userassistant"
    df = spark.createDataFrame([([("user", "a"), ("user", "b")],)], "messages array<struct<role: string, content: string>>")
    with pytest.raises(Exception, match="roles must alternate"):
        df.select(chat.render(source, {})(F.col("messages"))).collect()


def test_what_is_no_expression_is_interpreted(spark):
    """Other fields and contents of messages, unless they are named as texts."""
    schema = "messages array<struct<role: string, content: array<struct<type: string, text: string>>, name: string>>"
    df = spark.createDataFrame([([("user", [("text", "a"), ("image", None)], "n")],)], schema)
    source = "{% for m in messages %}{% for c in m.content %}{{ c.type }}{% if c.text %}={{ c.text }};{% endif %}{% endfor %}{{ m.name }}{% endfor %}"
    out = df.select(chat.render(source, {}, ())(F.col("messages")).alias("t"))
    assert "Python" in out._jdf.queryExecution().executedPlan().toString() and out.head().t == "text=a;imagen"
    named = df.select(F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["name"].alias("name"))).alias("messages"))
    for fields, python in ((None, True), (("role", "name"), False)):
        out = named.select(chat.render("{% for m in messages %}{{ m.role }}{{ m.name }}{% endfor %}", {}, fields)(F.col("messages")).alias("t"))
        assert ("Python" in out._jdf.queryExecution().executedPlan().toString()) == python and out.head().t == "usern"
    with pytest.raises(chat_columns.Unsupported):
        chat_columns.render(chat.Template("{{ messages | tojson }}"), F.col("messages"), None, {})


def test_language():
    render = lambda source, **context: chat.Template(source).render(context)
    assert render("{% for x in xs if x > 1 %}{{ x }}{% else %}none{% endfor %}", xs=[1, 2, 3]) == "23"
    assert render("{% for x in xs if x > 9 %}{{ x }}{% else %}none{% endfor %}", xs=[1]) == "none"
    assert render("{% for x in (xs if y else [7]) %}{{ x }}{% endfor %}", xs=[1], y=False) == "7"
    assert render("{% set n = namespace(c=0) %}{% for x in xs %}{% set n.c = n.c + x %}{% endfor %}{{ n.c }}", xs=[1, 2]) == "3"
    assert render("{% macro f(a, b=2) %}({{ a }}{{ b }}){% endmacro %}{{ f(1) }}{{ f(1, b=3) }}{{ f(a=5) }}") == "(12)(13)(52)"
    assert render("{% for x in xs %}{{ loop.previtem }}{{ x }}{{ loop.nextitem }},{% endfor %}", xs=[1, 2]) == "12,12,"
    for wrong in ("{% macro f( %}{% endmacro %}", "{% macro f() %}", "{% for x in xs if %}{% endfor %}", "{% for x in xs %}{% else %}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(wrong)
