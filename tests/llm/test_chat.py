"""Operator 2: round trip, digests and the tree's own rules."""

import hashlib
import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from veinworks.llm import chat_tree
from veinworks.llm.entries import op2_prefix_tree

TEXT = st.text(alphabet=st.one_of(st.sampled_from("\\#<>/turn:hlc \n"), st.characters(exclude_categories=["Cs"])), max_size=40)


@settings(max_examples=300, deadline=None)
@given(TEXT, TEXT)
def test_template_is_reversible(role, text):
    segment, _ = chat_tree.format_turn(role, text)
    assert chat_tree.parse_turn(segment) == (role, text)
    assert segment.count("###") == 1 and segment.count("</turn>") == 1


def expect(rows):
    talks = defaultdict(list)
    for c, turn, role, text in rows:
        talks[c].append(((turn is not None, turn or 0), role is not None, role or "", text is not None, text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for c, turns in talks.items():
        turns.sort()
        loss = "".join(t[4] for t in turns if t[2] == "assistant")
        whole = sum(len(chat_tree.format_turn(t[2], t[4])[0]) for t in turns)
        out.append((c, len(turns), sha("".join(f"{t[2]}\n{t[4]}\n" for t in turns)), len(loss), sha(loss), whole))
    return sorted(out, key=str)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    tricky = "\\### Assistant: </turn> ok"
    assert sorted(map(tuple, op2_prefix_tree(spark, sf_dir).collect()), key=str) == expect([*rows, (-7, 0, "user", tricky), (-7, 1, "assistant", tricky)])


def awkward(spark):
    rng = random.Random(1)
    rows = [(i, d, rng.choice(["user", "assistant"]), rng.choice("abc")) for i in range(200) for d in range(rng.randrange(1, 7))]
    rows += [(300, d, "assistant", f"deep {d}") for d in range(400)]
    rows += [(400, 0, None, None), (None, None, "user", "x"), (None, 1, "assistant", None), (401, 0, "sys: tem", "###</turn>\\"), (401, 0, "sys: tem", "###</turn>\\"), (402, 0, "assistant", "z" * 50_000)]
    return spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, cid string, part int"), rows


def test_awkward(spark):
    df, rows = awkward(spark)
    tree = chat_tree.build(df)
    assert sorted(map(tuple, chat_tree.digests(tree).collect()), key=str) == expect(rows)
    nodes = {n.start: n for n in tree.nodes.collect()}
    at = 0
    for start in sorted(nodes):  # depth-first, without gaps, each shared turn once
        assert start == at and len(nodes[start].segment) == nodes[start].length
        at += nodes[start].length
    histories = set()
    for _, starts in tree.index.collect():
        history, position = (), 0
        for i, s in enumerate(starts):
            history += (nodes[s].segment,)
            histories.add(history)
            assert nodes[s].position == position
            covered = [x for a in nodes[s].ancestors for x in range(a.start, a.stop)]
            assert covered == [x for b in starts[:i] for x in range(b, b + nodes[b].length)]
            position += nodes[s].length
    assert len(histories) == len(nodes)


def test_empty(spark):
    df, _ = awkward(spark)
    assert chat_tree.digests(chat_tree.build(df.limit(0))).count() == 0


def test_ranges_join():
    """Any cut of the order into ranges gives the same starts."""
    rng = random.Random(4)
    talks = sorted([rng.choice("ab") for _ in range(rng.randrange(1, 6))] for _ in range(60))

    def starts(cuts):
        out, summaries = [], []
        for p, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(talks)], strict=True)):
            last, own, end, rows = [], [], 0, []
            for path in talks[a:b]:
                new = chat_tree.shared(path, last)
                own = own[:new]
                for _ in path[new:]:
                    own.append(end)
                    end += 3
                last = path
                rows.append({"path": path, "lengths": [3] * len(path), "starts": own[:], "end": end})
            if rows:
                summaries.append({"part": p, "first": rows[0], "last": rows[-1]})
                out.append((p, rows))
        real = chat_tree.join_ranges(summaries)
        return [[s + real[p][1] - real[p][0] if s >= real[p][0] else real[p][2][d] for d, s in enumerate(r["starts"])] for p, rows in out for r in rows]

    assert all(starts(sorted(rng.sample(range(60), k))) == starts([]) for k in (1, 3, 10, 30, 59))
