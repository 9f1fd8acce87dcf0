"""Edit plans, replayed on plain text: inserts, then bullets from the last group to the first."""

from lectern.operators import edits
from lectern.plans import layout_queries as lq

SF = "/root/testdata/sf0.001"


def replay(plan, first=1):
    text = " " * first  # what stands before our text
    levels = {}
    for e in sorted(plan, key=lambda e: (e.phase, e.seq)):
        if e.op == "insertText":
            text = text[: e.start] + e.payload + text[e.start :]
        elif e.op == "createParagraphBullets":
            lines = text[e.start : e.end].split("\n")
            text = text[: e.start] + "\n".join(x.lstrip("\t") for x in lines) + text[e.end :]
            levels[e.start] = [len(x) - len(x.lstrip("\t")) for x in lines[:-1]]
    return text[first:], levels


def test_plans_write_the_text_and_take_the_tabs(spark):
    blocks = lq.line_blocks(spark, SF)
    plans, texts = {}, {}
    for e in edits.edit_plan(blocks).collect():
        plans.setdefault(e.doc_id, []).append(e)
    for b in blocks.orderBy("doc_id", "pos").collect():
        texts.setdefault(b.doc_id, []).append(b)
    assert plans.keys() == texts.keys()
    for doc, plan in plans.items():
        text, levels = replay(plan)
        assert text == "".join(b.text + "\n" for b in texts[doc])
        assert sum(map(len, levels.values())) == sum(b.kind == "bullet" for b in texts[doc])
        assert [n for _, own in sorted(levels.items()) for n in own] == [b.level for b in texts[doc] if b.kind == "bullet"]
        end = max(e.end for e in plan)
        assert all(1 <= e.start <= e.end <= end for e in plan)


def test_plans_start_where_told(spark):
    plan = edits.edit_plan(lq.line_blocks(spark, SF), first=100)
    assert plan.agg({"start": "min"}).first()[0] == 100
    assert edits.in_tab(plan, plan["doc_id"].cast("string")).where("tab_id is null").count() == 0
