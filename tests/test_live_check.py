"""Providers asked one small question, and settings merged by name."""

import http.server
import json
import threading

import pytest

from tessella import cli
from tessella.operators.provider import LIVE_TOKENS, ChatCompletions, Registry, Spec


@pytest.fixture
def server():
    """An endpoint that says ok, says no, isn't JSON, or fails, by the model's name; what it was asked is kept."""
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.headers["Authorization"], body))
            said = {"good": '{"ok": true}', "no": '{"ok": false}', "text": "certainly!"}.get(body["model"])
            self.send_response(200 if said else 503)
            self.end_headers()
            if said:
                self.wfile.write(json.dumps({"choices": [{"message": {"content": said}, "finish_reason": "stop"}]}).encode())

        def log_message(self, *args):
            pass

    made = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}/v1/chat/completions", asked
    made.shutdown()


def test_live_check(server):
    url, asked = server
    spec = lambda model, **more: Spec(**({"spec": f"chat:{model}", "endpoint": url, "api_key": "secret"} | more))
    registry = Registry({"default": spec("good"), "b": spec("no"), "c": spec("text"), "d": spec("down", max_retries=5), "e": Spec(), "f": spec("good", max_tokens=40), "g": spec("good", api_key=None)})
    rows = {r["name"]: r for r in registry.report(ChatCompletions)}
    assert {k: r["ok"] for k, r in rows.items()} == {"default": True, "b": False, "c": False, "d": False, "e": False, "f": True, "g": False}
    assert rows["default"]["message"] == "live ok" and rows["default"]["model_calls"] == 1 and rows["default"]["context"]["live_max_tokens"] == LIVE_TOKENS
    assert rows["f"]["context"]["live_max_tokens"] == 40 and all(rows[k]["message"].startswith("live check failed") for k in "bcd")
    assert "secret" not in json.dumps([r for r in rows.values()])
    models = [body["model"] for _, body in asked]
    assert sorted(models) == ["down", "good", "good", "no", "text"]  # once each, and not where there is nothing to ask
    del asked[:]
    assert {r["name"]: r["ok"] for r in registry.report()} == {"default": True, "b": True, "c": True, "d": True, "e": False, "f": True, "g": False} and asked == []


def test_settings_by_name(tmp_path, server, capsys):
    url, asked = server
    write = lambda name, found: (tmp_path / name).write_text(json.dumps(found)) and str(tmp_path / name)
    one = write("one.json", {"default": {"spec": "chat:no", "endpoint": url, "api_key": "k"}, "judge": {"spec": "chat:good", "endpoint": url, "api_key": "k"}})
    two = write("two.json", {"default": {"spec": "chat:good", "endpoint": url, "api_key": "own"}})
    merged = cli._registry(one, optional=(two, str(tmp_path / "missing.json")))
    assert merged.of("anything").api_key == "own" and merged.of("judge").api_key == "k"
    with pytest.raises(ValueError, match="by name"):
        cli._registry(write("bad.json", {"default": "chat:good"}))
    assert cli.main(["providers-check", one, "--live", "--json"]) == 2
    assert cli.main(["providers-check", one, "--over", two, "--live", "--json"]) == 0
    assert [body["model"] for _, body in asked][-2:] == ["good", "good"] and "Bearer own" in [key for key, _ in asked]
