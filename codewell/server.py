"""The search facades as a WSGI application of the standard library: five routes, JSON answers, uploads as form data.

``make_server("", 8000, application(engines)).serve_forever()`` with ``engines`` an ``api.Engines`` of text, audio and image.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import asdict
from email.parser import BytesParser
from email.policy import HTTP
from urllib.parse import parse_qs

from codewell.api import BadFormat, Engines, NotFound, Unavailable

_STATUS = {200: "200 OK", 400: "400 Bad Request", 404: "404 Not Found", 405: "405 Method Not Allowed", 422: "422 Unprocessable Entity", 500: "500 Internal Server Error", 503: "503 Service Unavailable"}
_JSON = "application/json"


class Invalid(ValueError):
    """A field is missing or of the wrong kind."""


def form(kind: str, body: bytes) -> dict[str, tuple[str, bytes]]:
    """Fields of a form by name: file name (empty for plain fields) and content."""
    if kind.startswith("application/x-www-form-urlencoded"):
        return {k: ("", v[-1].encode()) for k, v in parse_qs(body.decode(), keep_blank_values=True).items()}
    message = BytesParser(policy=HTTP).parsebytes(b"Content-Type: " + kind.encode("latin-1") + b"\r\n\r\n" + body)
    parts = message.iter_parts() if message.is_multipart() else ()
    return {str(p.get_param("name", header="content-disposition")): (p.get_filename() or "", p.get_payload(decode=True) or b"") for p in parts}


def application(engines: Engines) -> Callable[[dict, Callable], Iterable[bytes]]:
    """The WSGI callable over engines named ``text``, ``audio`` and ``image``."""

    def results(found: list) -> tuple[bytes, str]:
        return json.dumps([asdict(r) for r in found], ensure_ascii=False).encode(), _JSON

    def uploaded(fields: dict, name: str) -> tuple[str, bytes]:
        if name not in fields or not fields[name][0]:
            raise Invalid(name)
        return fields[name]

    def answer(method: str, path: str, query: dict, fields: dict) -> tuple[bytes, str]:
        try:
            top_k = int(query.get("top_k", ["5"])[-1])
        except ValueError as e:
            raise Invalid("top_k") from e
        if (method, path) == ("POST", "/search/text"):
            if "query_text" not in fields:
                raise Invalid("query_text")
            return results(engines["text"].search(fields["query_text"][1].decode(), top_k))
        if (method, path) == ("POST", "/search/audio"):
            engine, (name, content) = engines["audio"], uploaded(fields, "query_audio")
            return results(engine.search(content, name, top_k))
        if (method, path) == ("POST", "/search/image"):
            engine, (name, content) = engines["image"], uploaded(fields, "query_image")
            return results(engine.search(content, name, top_k))
        item = re.fullmatch(r"/(audio/stream|imagen/render)/(-?\d+)", path)
        if method == "GET" and item:
            return engines["audio"].stream(int(item[2])) if item[1].startswith("audio") else engines["image"].render(int(item[2]))
        raise NotFound(path)

    def run(environ: dict, start: Callable) -> Iterable[bytes]:
        status, body, kind = 200, b"", _JSON
        try:
            size = int(environ.get("CONTENT_LENGTH") or 0)
            raw = environ["wsgi.input"].read(size) if size else b""
            fields = form(environ.get("CONTENT_TYPE", ""), raw) if raw else {}
            body, kind = answer(environ["REQUEST_METHOD"], environ.get("PATH_INFO", "/"), parse_qs(environ.get("QUERY_STRING", "")), fields)
        except Unavailable as e:
            status, body = 503, str(e).encode()
        except BadFormat as e:
            status, body = 400, str(e).encode()
        except NotFound as e:
            status, body = 404, str(e).encode()
        except Invalid as e:
            status, body = 422, str(e).encode()
        except Exception as e:  # noqa: BLE001  one request must not end the server
            status, body = 500, type(e).__name__.encode()
        if status != 200:
            body = json.dumps({"detail": body.decode()}).encode()
        start(_STATUS[status], [("Content-Type", kind), ("Content-Length", str(len(body)))])
        return [body]

    return run
