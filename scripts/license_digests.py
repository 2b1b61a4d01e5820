"""Write tabsmith/llm/license_digests.py: digests of the full licence texts in a folder, with and without titles and appendices.

python scripts/license_digests.py [folder]    (/usr/share/common-licenses of Debian when not given)
"""

import hashlib
import re
import sys
from itertools import product
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from tabsmith.llm.licenses import canonical  # noqa: E402

GNU_HEADS = [r"^[ \t]*Copyright \(C\)", r"^[ \t]*Everyone is permitted"]
GNU_TAILS = [r"^[ \t]*(Appendix: )?How to Apply These Terms", r"^[ \t]*END OF TERMS AND CONDITIONS"]
GFDL_TAILS = [r"^[ \t]*ADDENDUM: How to use"]
MPL_HEADS = [r"^[ \t]*1\. Definitions"]
# file: licence, where a copy without its title may begin, where a copy without its appendix may end.
TEXTS = {
    "Apache-2.0": ("Apache-2.0", [r"^[ \t]*TERMS AND CONDITIONS FOR USE", r"^[ \t]*1\. Definitions"], [r"^[ \t]*APPENDIX: ", r"^[ \t]*END OF TERMS"]),
    "Artistic": ("Artistic-1.0-Perl", [r"^[ \t]*Preamble"], [r"^[ \t]*The End"]),
    "BSD": ("BSD-3-Clause", [], []),
    "CC0-1.0": ("CC0-1.0", [r"^[ \t]*CC0 1\.0 Universal", r"^[ \t]*CREATIVE COMMONS CORPORATION", r"^[ \t]*Statement of Purpose"], []),
    "GFDL-1.2": ("GFDL-1.2-only", GNU_HEADS, GFDL_TAILS),
    "GFDL-1.3": ("GFDL-1.3-only", GNU_HEADS, GFDL_TAILS),
    "GPL-1": ("GPL-1.0-only", GNU_HEADS, GNU_TAILS),
    "GPL-2": ("GPL-2.0-only", GNU_HEADS, GNU_TAILS),
    "GPL-3": ("GPL-3.0-only", GNU_HEADS, GNU_TAILS),
    "LGPL-2": ("LGPL-2.0-only", GNU_HEADS, GNU_TAILS),
    "LGPL-2.1": ("LGPL-2.1-only", GNU_HEADS, GNU_TAILS),
    "LGPL-3": ("LGPL-3.0-only", GNU_HEADS, []),
    "MPL-1.1": ("MPL-1.1", MPL_HEADS, [r"^[ \t]*EXHIBIT A"]),
    "MPL-2.0": ("MPL-2.0", MPL_HEADS, [r"^[ \t]*Exhibit A - ", r"^[ \t]*Exhibit B - "]),
}
# The addresses of the Free Software Foundation that copies of one text were given, in canonical form.
ADDRESSES = [
    "51 franklin street fifth floor boston ma 02110 1301 usa",
    "51 franklin st fifth floor boston ma 02110 1301 usa",
    "59 temple place suite 330 boston ma 02111 1307 usa",
    "675 mass ave cambridge ma 02139 usa",
]


def variants(text: str, heads: list[str], tails: list[str]) -> set[str]:
    """Canonical forms of a text, whole and without its title or appendix, under each address."""
    find = lambda p: re.search(p, text, re.M).start()
    out = {canonical(text[a:b]) for a, b in product([0, *map(find, heads)], [len(text), *map(find, tails)])}
    return out | {t.replace(a, b) for t in out for a, b in product(ADDRESSES, ADDRESSES)}


def digests(folder: Path) -> dict[str, str]:
    """digest -> licence."""
    return {
        hashlib.sha256(form.encode()).hexdigest(): name
        for file, (name, heads, tails) in TEXTS.items()
        for form in variants((folder / file).read_text(), heads, tails)
    }


if __name__ == "__main__":
    found = digests(Path(sys.argv[1] if len(sys.argv) > 1 else "/usr/share/common-licenses"))
    rows = "".join(f'    "{d}": "{name}",\n' for d, name in sorted(found.items(), key=lambda x: (x[1], x[0])))
    (ROOT / "tabsmith/llm/license_digests.py").write_text(
        '"""SHA-256 of the canonical forms of full licence texts; written by scripts/license_digests.py."""\n\n'
        f"FULL_TEXTS = {{\n{rows}}}\n"
    )
