"""Builds transcripts out of record shapes."""

import json


class Builder:
    def __init__(self, session="session-0001", sidechain=False):
        self.session, self.sidechain, self.lines, self.n, self.parent = session, sidechain, [], 0, None

    def add(self, kind, **fields):
        uuid = f"{self.n:08x}-0000-0000-0000-000000000000"
        self.n += 1
        rec = {"type": kind, "uuid": uuid, "parentUuid": self.parent, "sessionId": self.session, **({"isSidechain": True} if self.sidechain else {}), **fields}
        self.parent = uuid
        self.lines.append(json.dumps(rec, ensure_ascii=False, separators=(",", ":")))
        return uuid

    def bare(self, kind, **fields):
        self.lines.append(json.dumps({"type": kind, "sessionId": self.session, **fields}, ensure_ascii=False, separators=(",", ":")))

    def user(self, text):
        return self.add("user", message={"role": "user", "content": text})

    def blocks(self, *blocks, kind="assistant", **more):
        return self.add(kind, message={"role": kind, "content": list(blocks)}, **more)

    def say(self, text):
        return self.blocks({"type": "text", "text": text})

    def use(self, id_, name, **given):
        return self.blocks({"type": "tool_use", "id": id_, "name": name, "input": given})

    def result(self, id_, content, error=False, **more):
        return self.blocks({"type": "tool_result", "tool_use_id": id_, "content": content, **({"is_error": True} if error else {})}, kind="user", **more)

    def call(self, id_, name, content, **given):
        self.use(id_, name, **given)
        return self.result(id_, content)

    @property
    def text(self):
        return "\n".join(self.lines) + "\n"


def readable(session="session-0001"):
    """Eight prompts with a read of the same lines each, then a closing word."""
    b = Builder(session)
    for i in range(8):
        b.user(f"look again {i}")
        b.call(f"t{i}", "Bash", f"{i} " + "x" * 500, command="sed -n '1,100p' a.py")
    b.say("done")
    return b
