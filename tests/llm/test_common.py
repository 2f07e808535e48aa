from lakeloom.llm import common
from lakeloom.llm.common import process_store


class Task:
    def __init__(self, stage):
        self.stage = stage

    def stageId(self):  # noqa: N802
        return self.stage


def test_values_of_earlier_stages_go_when_a_new_one_is_made(monkeypatch):
    made = []

    def get(name, stage):
        monkeypatch.setattr(common.TaskContext, "get", classmethod(lambda cls: Task(stage)))
        return process_store(name, lambda: made.append(name) or [name])

    first = get("test-a", 1)
    assert get("test-a", 1) is first and get("test-b", 1) == ["test-b"] and get("test-a", 1) is first
    assert get("test-a", 2) is first  # still wanted
    get("test-c", 2)  # drops b, which stage 2 has not asked for
    assert get("test-a", 2) is first and get("test-b", 2) == ["test-b"]
    assert made == ["test-a", "test-b", "test-c", "test-b"]
