"""The tools over standard input and output: one JSON-RPC 2.0 message a line, as the model context protocol has it."""

from __future__ import annotations

import json
import sys
from typing import TextIO

from .tools import ToolError, Tools

PROTOCOL, INDEX_URI = "2024-11-05", "notes://index"


def handle(tools: Tools, message: dict) -> dict | None:
    """The reply to one message; None for a notification."""
    if "id" not in message:
        return None
    params = message.get("params") or {}
    try:
        result = _result(tools, message.get("method"), params)
    except KeyError as e:
        return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": -32601, "message": f"no method or resource {e.args[0]}"}}
    return {"jsonrpc": "2.0", "id": message["id"], "result": result}


def _result(tools: Tools, method: str | None, params: dict) -> dict:
    if method == "initialize":
        return {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}, "resources": {}}, "serverInfo": {"name": "quillspark", "version": "1"}}
    if method == "ping":
        return {}
    if method == "tools/list":
        return {"tools": [{"name": d["name"], "description": d["description"], "inputSchema": d["input_schema"]} for d in tools.definitions()]}
    if method == "tools/call":
        try:
            said, failed = json.dumps(tools.call(params.get("name", ""), params.get("arguments") or {}), ensure_ascii=False), False
        except ToolError as e:
            said, failed = str(e), True
        return {"content": [{"type": "text", "text": said}], "isError": failed}
    if method == "resources/list":
        return {"resources": [{"uri": INDEX_URI, "name": "index", "mimeType": "text/markdown"}]}
    if method == "resources/read" and params.get("uri") == INDEX_URI:
        page = tools.index.pages().where("path = 'INDEX.md'").first()
        return {"contents": [{"uri": INDEX_URI, "mimeType": "text/markdown", "text": page.text if page else ""}]}
    raise KeyError(params.get("uri") or method)


def serve(tools: Tools, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
    for line in source:
        if not line.strip():
            continue
        try:
            reply = handle(tools, json.loads(line))
        except json.JSONDecodeError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if reply is not None:
            sink.write(json.dumps(reply, ensure_ascii=False) + "\n")
            sink.flush()
