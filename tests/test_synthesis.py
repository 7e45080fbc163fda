import datetime as dt

from quern.plans import synthesis
from quern.sources.provider import Scripted
from quern.sources.store import Store

T0 = dt.datetime(2024, 1, 1)


def at(h):
    return T0 + dt.timedelta(hours=h)


def test_turns_to_merged_memory(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    turns = [(i, "s", i, "closed", "/w", None, f"prompt {i}", at(10 - i), at(20 + i)) for i in range(1, 5)] + [(9, "s", 9, "open", "/w", None, "p", at(30), None)]
    s.write("turns", spark.createDataFrame(turns, "turn_id bigint, session_id string, seq bigint, state string, cwd string, repo string, prompt_text string, started_at timestamp_ntz, stopped_at timestamp_ntz"))
    turn = Scripted([("prompt 1", '{"title":"One","topic_candidate":"Auth"}'), ("prompt 2", '{"title":"Two","topic_candidate":" auth. "}'), ("prompt 3", '{"title":"Three","topic_candidate":"AUTH"}')], "broken")
    for _ in range(2):  # again: nothing new
        synthesis.summarise_turns(s, turn)
    m = {r.title: r for r in s.read("memories").collect()}
    assert set(m) == {"One", "Two", "Three", "Untitled turn"} and sorted(r.id for r in m.values()) == [1, 2, 3, 4] and s.read("memory_embeddings").count() == 4
    crossed = synthesis.normalise_topics(s, Scripted([], "no json"), at(50)).collect()
    topics = {r.canonical_label.strip(" .").lower(): r for r in s.read("topics").collect()}
    assert topics["auth"].memory_count == 3 and len(topics) == 2 and [r.memory_count for r in crossed] == [3]
    assert synthesis.normalise_topics(s, Scripted([], "no json"), at(51)).count() == 0
    synthesis.summarise_topics(s, Scripted([], '{"summary":"fine","unresolved_summary":"left"}'))
    synthesis.summarise_topics(s, Scripted([], "bad"))
    assert {r.unresolved_summary for r in s.read("topics").collect()} == {"left"}
    again = synthesis.merge_clusters(s, Scripted([("Topic", '{"title":"All"}')])).collect()
    assert [r.topic_id for r in again] == [topics["auth"].topic_id]
    merged = s.read("memories").where("memory_kind = 'merged'").first()
    assert merged.source_turn_count == 3 and merged.first_turn_at == at(7) and merged.last_turn_at == at(23) and merged.id == 5
    links = s.read("memory_turn_links").where(f"memory_id = {merged.id}").orderBy("ordinal").collect()
    assert [(r.turn_id, r.ordinal) for r in links] == [(3, 1), (2, 2), (1, 3)]
    assert s.read("memories").where("state = 'superseded'").count() == 3 and synthesis.merge_clusters(s, Scripted([])).count() == 0
