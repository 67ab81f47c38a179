"""Command line: validate, profile, draft, compare, diff, profile-diff, history, init, config. Exit codes: 0 passed, 1 failed, 2 usage, 3 error."""

from __future__ import annotations

import argparse
import json
import os
import sys

from plumbline import api
from plumbline.model import ContractError
from plumbline.operators.history import HistoryStore

OK, FAILED, USAGE, ERROR = 0, 1, 2, 3

_SAMPLE = """name: example
datasource: data.parquet
rules:
  - name: min_rows
    params: {threshold: 1}
"""


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: str, **options: dict) -> None:
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a, nargs="?" if a.endswith("?") else None) if not a.endswith("?") else s.add_argument(a[:-1], nargs="?")
        for k, v in options.items():
            s.add_argument("--" + k.replace("_", "-"), **v)

    out, store = {"choices": ["text", "json"], "default": "text"}, {"default": ".plumbline/state"}
    command("validate", "contract", data={}, tally={"action": "store_true"}, sample={"type": int, "default": 0}, only={"nargs": "*"}, columns={"nargs": "*"}, output={"choices": ["text", "json", "table"], "default": "text"}, store={}, dry_run={"action": "store_true"}, explain={"action": "store_true"}, no_preplan={"action": "store_true"})
    command("profile", "data", preset={"default": "scan"}, output={"choices": ["text", "json", "markdown"], "default": "text"}, columns={"nargs": "*"}, sample={"type": int}, draft={"action": "store_true"}, store={})
    command("compare", "before", "after", key={"nargs": "+", "required": True}, output=out)
    command("diff", "contract", store=store, output=out)
    command("profile-diff", "data", store=store)
    command("history", "contract", store=store, limit={"type": int, "default": 20}, failed_only={"action": "store_true"})
    command("init", "folder?")
    command("config", environment={})
    return p


def main(argv: list[str] | None = None) -> int:
    try:
        a = _parser().parse_args(argv)
    except SystemExit as e:
        return OK if e.code == 0 else USAGE
    try:
        return _run(a)
    except ContractError as e:
        print(f"error: {e}", file=sys.stderr)
        return USAGE
    except Exception as e:
        print(f"error: {type(e).__name__}: {e}", file=sys.stderr)
        return ERROR


def _store(root: str | None) -> HistoryStore | None:
    return HistoryStore(api._spark(), root if "://" in root else os.path.abspath(root)) if root else None


def _run(a: argparse.Namespace) -> int:
    show = lambda x: print(json.dumps(x, indent=2, default=str))
    if a.command == "init":
        folder = a.folder or "."
        os.makedirs(f"{folder}/contracts", exist_ok=True)
        path = f"{folder}/contracts/example.yml"
        if os.path.exists(path):
            raise ContractError(f"{path} is there already")
        with open(path, "w") as f:
            f.write(_SAMPLE)
        print(path)
    elif a.command == "config":
        show(api.config(a.environment))
    elif a.command == "validate":
        if a.explain:
            from plumbline.sources.contracts import as_contract

            show(api.explain(a.data or as_contract(a.contract).datasource, a.contract, tally=a.tally or None))
            return OK
        r = api.validate(a.data, a.contract, tally=a.tally or None, sample=a.sample, only=a.only, columns=a.columns, store=_store(a.store), preplan=not a.no_preplan, dry_run=a.dry_run)
        if a.dry_run:
            show(r)
            return OK
        print({"json": lambda: r.to_json(2), "text": r.to_llm, "table": r.to_text}[a.output]())
        return OK if r.passed else FAILED
    elif a.command == "profile":
        p = api.profile(a.data, "interrogate" if a.draft else a.preset, columns=a.columns, sample=a.sample, store=_store(a.store))
        print(api.draft(p, as_yaml=True) if a.draft else {"json": lambda: p.to_json(2), "markdown": p.to_markdown, "text": p.to_llm}[a.output]())
    elif a.command == "compare":
        show(api.compare(a.before, a.after, a.key))
    elif a.command == "diff":
        found = api.diff(a.contract, _store(a.store))
        show(found)
        return FAILED if found and found["worse"] else OK
    elif a.command == "profile-diff":
        show(api.profile_diff(_store(a.store), a.data))
    elif a.command == "history":
        show(api.get_history(a.contract, _store(a.store), a.limit, failed_only=a.failed_only))
    return OK


if __name__ == "__main__":
    sys.exit(main())
