"""Plans whose figures must not grow with the corpus."""

import re

import pyarrow as pa
import pytest

from quiremill.plans import extra
from quiremill.plans.queries import QUERIES
from quiremill.sources import adapters as A
from quiremill.sources.shared import kept

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["ag16_fill_summary", "jn5_mapping", "jn6_filled_slots", "st3_blank_slots"])
def test_only_the_fixed_aliases_are_broadcast(spark, name):
    assert plan(QUERIES[name](spark, SF)).count("BroadcastHashJoin") == 1


def test_mapping_shuffles_by_document_and_person_alone(spark):
    """Slots, values and repeated cells meet by document; nothing is dealt anew for a longer key, and of the cells only ends and labels travel."""
    text = plan(QUERIES["jn5_mapping"](spark, SF))
    keys = {",".join(re.findall(r"(\w+)#", k)) for k in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)}
    assert keys == {"l_orderkey", "person_id", "doc_id", "doc_id,table_index"}
    assert all("partial_max" in line for line in re.findall(r"hashpartitioning\(doc_id#\w+, table_index.*\n(.*)", text))


def test_findings_broadcast_nothing(spark):
    assert "BroadcastHashJoin" not in plan(QUERIES["st2_findings"](spark, SF))


@pytest.mark.parametrize("name", ["jn2_label_targets", "st1_all_slots", "wn17_deleted_rows", "sc21_built_blocks", "jn15_images", "jn9_unpaired_fields", "sc21_markdown_blocks", "ag11_box_heights"])
def test_shuffles_follow_the_input(spark, name):
    shuffles = [line for line in plan(QUERIES[name](spark, SF)).splitlines() if "Exchange hashpartitioning" in line]
    assert shuffles and any("REPARTITION_BY_NUM" in line for line in shuffles)


def test_few_packages_are_held():
    class Table:
        def mapInArrow(self, run, _):  # noqa: N802
            return run

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["x"] * 1000)], names=["doc_id", "text"])
    sizes = [b.num_rows for b in A.packed(Table(), lambda _, t: t.encode())(iter([batch]))]
    assert sum(sizes) == 1000 and max(sizes) <= 128
    sizes = [b.num_rows for b in A.packed(Table(), lambda _, t: t.encode() * (1 << 20))(iter([batch.slice(0, 10)]))]
    assert sum(sizes) == 10 and max(sizes) <= 2


def test_packages_are_built_once_a_landing(spark, monkeypatch):
    written = []
    monkeypatch.setattr(extra, "kept", lambda df: written.append(kept(df)) or written[-1])
    assert QUERIES["src11_landing_log"](spark, SF).count() > 200 and len(written) == 2
