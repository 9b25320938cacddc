"""Completion scripts for shells, written from the parser's own options."""

from __future__ import annotations

import argparse

SHELLS = ("bash", "zsh", "fish")


def options(parser: argparse.ArgumentParser) -> list[str]:
    return sorted({s for a in parser._actions for s in a.option_strings})


def script(shell: str, parser: argparse.ArgumentParser, commands: list[str]) -> str:
    """A script for a shell of SHELLS; ValueError for another."""
    words, prog = [*options(parser), *commands], parser.prog
    if shell == "bash":
        return f'_{prog}() {{ COMPREPLY=($(compgen -f -W "{" ".join(words)}" -- "${{COMP_WORDS[COMP_CWORD]}}")); }}\ncomplete -o filenames -F _{prog} {prog}'
    if shell == "zsh":
        return f"#compdef {prog}\n_alternative 'options:option:({' '.join(words)})' 'files:file:_files'"
    if shell == "fish":
        flags = [f"complete -c {prog} " + (f"-l {w[2:]}" if w.startswith("--") else f"-s {w[1:]}" if len(w) == 2 and w[0] == "-" else f"-a {w}") for w in words]
        return "\n".join(flags)
    raise ValueError(f"no completions for {shell}; there are: {', '.join(SHELLS)}")
