import random

from llm_support import odd_rows, prose
from test_bpe import mixed

from ladder.llm import token_counts
from ladder.llm.bpe import default_pattern, encoder

RANKS, PATTERN = token_counts.default_ranks(), default_pattern()


def count(text):
    return len(encoder(RANKS, PATTERN)[0].encode_ordinary(text))


def test_edits_equal_counting_anew():
    r = random.Random(4)
    for s in range(60):
        text = mixed(s, r.randint(0, 400)) if s % 2 else prose(s, r.randint(0, 400))
        tree = token_counts.Tree.of(text, RANKS, PATTERN, leaf=r.choice([1, 2, 5, 64]))
        assert tree.tokens[1] == count(text) and tree.chars[1] == len(text)
        for step in range(15):
            a = r.randint(0, len(text) + 2)
            b = r.choice([a, a + 1, a + 3, a + 40, a + 500])
            new = r.choice(["", " ", "'", "s", "x y", mixed(step, 5), prose(step, 40)])
            tree.edit(a, b, new)
            start, end = min(a, len(text)), min(b, len(text))
            text = text[:start] + new + text[end:]
            assert tree.text == text
            assert (tree.chars[1], tree.tokens[1]) == (len(text), count(text)), (s, step)
            for i in range(1, tree.width):
                assert tree.tokens[i] == tree.tokens[2 * i] + tree.tokens[2 * i + 1]


def test_a_small_edit_reencodes_little():
    text = prose(1, 20_000)
    tree = token_counts.Tree.of(text, RANKS, PATTERN)
    tree.encoded_chars = 0
    tree.edit(60_000, 60_003, "new")
    assert tree.encoded_chars < 2000 and tree.tokens[1] == count(tree.text)


def edited(text):
    n = len(text)
    tenth = n * 45 // 100
    text = "Edited " + text
    text = text[:7 + tenth] + text[7 + tenth:7 + tenth + n // 10] + text[7 + tenth:]
    end = 7 + n + n // 10
    return text[:end - n // 20] + text[end:]


def test_query_equals_brute_force(odd, small, none):
    for docs, rows in ((odd, [(r[0], r[1] or "") for r in odd_rows()]), (small, [(r.doc_id, r.text) for r in small.collect()])):
        got = token_counts.edited_counts(docs).collect()
        want = [(i, len(t), len(edited(t)), count(t), count(edited(t))) for i, t in rows]
        assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    assert sum(r.reencoded_chars for r in got) < 0.6 * sum(r.n_chars for r in got)
    assert token_counts.edited_counts(none).count() == 0


def test_trees_can_be_kept_and_edited_later(spark, odd):
    trees = token_counts.build_trees(odd).selectExpr(
        "*", "array(named_struct('from', 2, 'upto', 4, 'new', 'zz'), named_struct('from', 0, 'upto', 0, 'new', null)) edits")
    once = token_counts.apply_edits(trees)
    again = token_counts.apply_edits(once.select("doc_id", "text", "leaf_chars", "leaf_tokens").selectExpr(
        "*", "array(named_struct('from', 1, 'upto', 1, 'new', 'q')) edits"))
    for r in again.collect():
        assert r.n_tokens_edited == count(r.text) and sum(r.leaf_tokens) == count(r.text)
    nothing = token_counts.apply_edits(token_counts.build_trees(odd).selectExpr(
        "*", "cast(null as array<struct<from:int,upto:int,new:string>>) edits"))
    assert all(r.n_tokens == r.n_tokens_edited and not r.reencoded_chars for r in nothing.collect())
