"""A small vault of our own notes, written to a folder."""

from __future__ import annotations

from pathlib import Path

NOTES = {
    "10-Work/Cache plan.md": "---\ntype: project-note\nstatus: active\ndate: 2024-01-02\nupdated: 2024-02-01\ntags: [cache, spring-boot]\naliases: Caching\nrelated: ['[[Index]]', '[[Index]]', plain]\n---\n# Cache plan\nIntro about stampede control.\n\n## Next Actions\n- [ ] write the limiter\n- [x] read the paper\n```sh\n# not a heading [[Nowhere]]\n- [ ] not a task\n```\n## Notes\nSee [[Index|the index]] and [[2024-03-01 Talk]].\n- [ ] later\n",
    "10-Work/Index.md": "---\ntype: moc\n---\n# Index\nAll notes. [[Cache plan]] [[Missing]] [[Dup]] [[Gone]]\n",
    "10-Work/Dup.md": "---\ntype: learning-note\ndate: 2024-05-05\ntags: springboot\n---\n# One\nText <!-- hidden\n[[Cache plan]]\n--> shown\n",
    "20-Learning/Dup.md": "---\ntype: web-clip\ndate: '2024-13-45'\ntags: [Bad_Tag, a, b, c, d, e]\n---\n# Two\nShort.\n",
    "20-Learning/2024-03-01 Talk.md": "---\ntype: learning-note\ndate: 2024-03-01\ntags: [talk]\n---\n知识库检索 works well.\nSecond line.\n",
    "20-Learning/broken.md": "---\ntype: [unclosed\n---\nbody\n",
    "20-Learning/open.md": "---\ntype: learning-note\nno end\n",
    "20-Learning/list.md": "---\n- a\n- b\n---\nbody\n",
    "20-Learning/bare.md": "No metadata at all.\n```\nfence never closed\n",
    "Templates/T.md": "---\ntype: learning-note\n---\n# {{title}}\n",
    ".obsidian/x.md": "hidden",
    "docs/superpowers/y.md": "left out of audits",
    "README.MD": "read me",
}


def write(folder: Path) -> str:
    for name, text in NOTES.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8", newline="")
    (folder / "10-Work/crlf.md").write_bytes("﻿---\r\ntype: insight-note\r\ndate: 2024-06-01\r\n---\r\n# CR\r\nline\r\n".encode())
    return f"file://{folder}"
