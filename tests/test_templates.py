"""Prompt templates: single pass, loops, choices, errors."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import templates as P


@pytest.fixture(scope="module")
def row(spark):
    schema = "a string, b string, n int, none string, yes boolean, xs array<string>, ms array<struct<role:string,parts:array<struct<t:string>>>>"
    return spark.createDataFrame([("{b}", "z{{a}}{% if %}", 0, None, True, ["x", None, "{a}"], [("user", [("1",), ("2",)]), ("bot", []), (None, None)])], schema)


def said(row, column):
    return row.select(column.alias("out")).first()[0]


def columns(row):
    return {c: F.col(c) for c in row.columns}


def test_formatted(row):
    cases = {
        "{a}-{b}": "{b}-z{{a}}{% if %}", "{{a}} {{{a}}}": "{a} {{b}}", "{absent} {<|pad|>} {": "{absent} {<|pad|>} {", "{none}|{n}|{yes}": "|0|true",
        "{xs[0]}{xs[2]}{xs[9]}": "x{a}", "{ms[0].role}{ms[0][role]}": "useruser", "": "",
    }
    for template, want in cases.items():
        assert said(row, P.formatted(template, columns(row))) == want, template


def test_rendered(row):
    cases = {
        "{{ a }}{{b}}\n": "{b}z{{a}}{% if %}", "{{ a | replace('b', '{{ b }}') | upper }}": "{{{ B }}}", " {{- ' x ' | trim -}}  y": "xy", "{# {{ absent }} #}k": "k",
        "{% for x in xs %}{{ loop.index }}{{ x }}{% if not loop.last %},{% endif %}{% endfor %}": "1x,2,3{a}",
        "{% for m in ms %}{{ m.role | default('?') }}[{% for p in m.parts %}{{ loop.index0 }}{{ p.t }}{{ m.role }}{% endfor %}]{% endfor %}": "user[01user12user]bot[]?[]",
        "{% if n %}1{% elif none %}2{% elif yes and a == '{b}' %}3{% else %}4{% endif %}": "3", "{% if n or not none %}y{% endif %}{% if a != a %}n{% endif %}": "y",
        "{{ xs | join('+') }} {{ xs | count }} {{ a | length }} {{ xs | first }} {{ xs | last }} {{ 7 }}": "x++{a} 3 3 x {a} 7",
        "{%- for x in none_list %}{{ x }}{% else_ %}{% endfor %}": None, "": "", "{{ xs[0] }}{{ xs[5] }}{{ ms[0]['role'] }}": "xuser",
    }
    for template, want in cases.items():
        if want is None:
            with pytest.raises(ValueError):
                P.rendered(template, columns(row))
        else:
            assert said(row, P.rendered(template, columns(row))) == want, template


@pytest.mark.parametrize("bad", ["{{ }}", "{{ a b }}", "{{ a | nofilter }}", "{{ nothing }}", "{% if a %}", "{% endfor %}", "{% for a %}{% endfor %}", "{% else %}", "{% if a %}{% else %}{% else %}{% endif %}", "{{ a + b }}", "{% if a %}{% endfor %}"])
def test_errors(row, bad):
    with pytest.raises(ValueError):
        P.rendered(bad, columns(row))


def test_families(row):
    assert said(row, P.for_family(F.lit("<image>Q{<|image_pad|>}"), "qwen2_5vl")) == "<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n<|im_start|>user\nQ<|vision_start|><|image_pad|><|vision_end|><|im_end|>\n<|im_start|>assistant\n"
    assert said(row, P.for_family(F.lit("<image>Q"), "qwen3_nothink")) == "<|im_start|>user\n<image>Q<|im_end|>\n<|im_start|>assistant\n"
    with pytest.raises(ValueError):
        P.for_family(F.lit(""), "other")
