"""Any change of formatting keeps a formula's canonical form; any change of a letter, digit or position does not."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from loomgrid.llm.formatting import canonical

LEAF = st.sampled_from(["$low", "close", "57d", "ts_x", "3"])


def _node(children):
    named = st.tuples(st.just("named"), st.sampled_from("FGH"), st.lists(st.tuples(st.sampled_from("xyzd"), children), min_size=1, max_size=4, unique_by=lambda t: t[0]))
    plain = st.tuples(st.just("plain"), st.sampled_from("FGH"), st.lists(children, min_size=1, max_size=3))
    return named | plain


TREE = st.recursive(LEAF, _node, max_leaves=12)


def _text(tree, rng):
    if isinstance(tree, str):
        return tree if rng is None or rng.random() < 0.5 else tree.upper().replace("$", "@")
    kind, name, args = tree
    if kind == "named":
        args = list(args)
        if rng:
            rng.shuffle(args)
        sign = "=" if rng is None else rng.choice(["=", " = ", ": ", " :"])
        parts = [f"{k}{sign}{_text(a, rng)}" for k, a in args]
    else:
        parts = [_text(a, rng) for a in args]
    if rng is None:
        return f"{name}({','.join(parts)})"
    left, right = rng.choice(["()", "[]", "{}"])
    return f"{name.lower()} {left}{rng.choice([', ', ' ; ', ',\n'])}".rstrip(", ;\n") + rng.choice([", ", " ;", ",\n"]).join(parts) + right


@settings(max_examples=200, deadline=None)
@given(TREE, st.integers(0, 10**6))
def test_formatting_does_not_matter(tree, seed):
    assert canonical(_text(tree, None)) == canonical(_text(tree, random.Random(seed)))


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80))
def test_any_text_has_a_form_without_punctuation(text):
    form = canonical(text)
    assert not any(c.isspace() or c in "()[]{},;:=_$@" for c in form)
    assert canonical(form) == form
