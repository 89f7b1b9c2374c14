"""A registry of named commands: aliases, middleware, a dispatcher that also takes subject and verb in either order."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

VERBS = frozenset("list ls show add help note done stats summary".split())


@dataclass
class Command:
    name: str
    run: Callable
    meta: dict = field(default_factory=dict)
    render: Callable | None = None
    file: str | None = None


class Commands:
    def __init__(self):
        self.registry: dict[str, Command] = {}
        self.aliases: dict[str, str] = {}
        self.middleware: list[Callable] = []

    def register(self, name: str, run: Callable, meta: dict | None = None, render: Callable | None = None, file: str | None = None) -> Command:
        if not callable(run):
            raise TypeError(f"command {name} cannot be called")
        command = self.registry[name] = Command(name, run, meta or {}, render, file)
        for alias in command.meta.get("aliases", ()):
            self.alias(alias, name)
        return command

    def alias(self, alias: str, name: str) -> None:
        self.aliases[alias] = name

    def use(self, middleware: Callable) -> None:
        """middleware(context, next): what it does not pass on is not run."""
        self.middleware.append(middleware)

    def resolve(self, name: object) -> str | None:
        return self.aliases.get(name, name) if isinstance(name, str) else None

    def _turned(self, name: str, args: tuple) -> tuple[str, tuple] | None:
        """'list tasks' as 'tasks list', where tasks is a command and list a verb, or no command at all."""
        first, *rest = (*str(args[0]).split(), *args[1:]) if args and isinstance(args[0], str) and args[0].strip() else (None,)
        subject, verb = self.resolve(first), self.resolve(name)
        known = subject in self.registry and subject not in VERBS
        if known and (verb in VERBS or verb not in self.registry):
            return subject, (verb, *rest)
        return None

    def run(self, name: str, *args, **options) -> dict:
        """The context of a run: name, args, result, output, and error if it failed."""
        if turned := self._turned(name, args):
            name, args = turned
        own = self.registry.get(self.resolve(name))
        if own is None:
            return {"type": "error", "message": f"unknown tool {name}"}
        context = {"name": own.name, "commands": self, "args": list(args), "media": "text", **options, "result": None, "output": None}

        def call() -> None:
            try:
                if ":" in name:  # a key-value handler: (key, value, get)
                    context["result"] = own.run(name.removeprefix("kv:"), args[0] if args else None, lambda k, v=None: self.run(k, v)["result"])
                else:
                    context["result"] = own.run(*args, context)
                context["output"] = own.render(context["result"]) if own.render else context["result"]
            except Exception as e:  # a failed command is a result, not the dispatcher's end
                context["error"] = str(e)
                context["result"] = {"type": "error", "message": f"tool {own.name} failed: {e}"}

        def step(k: int) -> None:
            self.middleware[k](context, lambda: step(k + 1)) if k < len(self.middleware) else call()

        step(0)
        return context

    def load(self, folder: str) -> list[str]:
        """Register the `run` (and `meta`, `render`) of each Python file of a folder; a .help file beside it is its help."""
        out = []
        for p in sorted(Path(folder).glob("*.py")):
            spec = importlib.util.spec_from_file_location(f"command_{p.stem}", p)
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            if problems := self.validate(module):
                raise ValueError(f"{p}: {', '.join(problems)}")
            meta = dict(getattr(module, "meta", {}))
            if (side := p.with_suffix(".help")).exists():
                meta["help"] = side.read_text()
            self.register(meta.get("name", p.stem), module.run, meta, getattr(module, "render", None), str(p))
            out.append(meta.get("name", p.stem))
        return out

    @staticmethod
    def validate(module) -> list[str]:
        problems = [] if callable(getattr(module, "run", None)) else ["no function run"]
        return problems + ([] if isinstance(getattr(module, "meta", {}), dict) else ["meta is no map"])
