"""Small documents for parsers whose input the driver's tables do not hold."""

from __future__ import annotations

PDF_LINES = [
    "Chapter 2 Storage", "ARTICLE 14 - Keys", "Section IV: Scope", "Artículo 7. Plazos", "capitulo III", "Anexo II Tablas", "3. Results", "2.1.4 Detailed findings", "4. and so it goes on", "2016 Annual report",
    "DATA PROTECTION OFFICER", "AN EXTREMELY LONG LINE IN CAPITALS THAT GOES ON AND ON PAST THE LIMIT OF EIGHTY CHARACTERS", "An ordinary sentence about nothing.", "", "Part mix of things",
]
MARKDOWN = """lost before any heading
# Orchard manual

Trees need light, water
and patience.

- Pruning happens in late winter, before any of the buds open
  and on dry days only
    - Cherries are an exception: they are pruned after the harvest
- short

## Grafting

```sh
# not a heading
graft --scion apple
```

Tools
-----
1. A grafting knife with a straight blade, kept very sharp
2) Rubber strips to bind the union until it has healed over

Annex
=====
Nothing more.
"""
PDF_PAGES = ["User manual\nChapter 1 Basics\nThis chapter explains what\nthe device does.\n1. Setup\nPlug it in.\n1.1 Power\nUse the cable.", "Article 5 - Safety\nDo not open the case.\n1. Batteries\nKeep them dry.\nWARRANTY TERMS\nTwo years from purchase."]
PYTHON = '''"""Round shapes."""
import math


class Circle:
    """All points at one distance from a centre."""

    def __init__(self, radius):
        self.radius = radius

    def area(
        self,
        scale=1.0,
    ):
        """Area of the disc, scaled."""
        def helper():
            return 2
        return math.pi * self.radius**helper() * scale

    class Arc:
        def length(self):
            return 0


async def draw(shape):
    return shape
'''
_BODY = "<div class='entry-content'><ol><li>The controller shall keep records of what it does with the data.<ol><li>the purposes of the processing and the categories of data</li><li>too short</li></ol></li><li>Short one.</li></ol></div>"
LEGAL = f"<h1>Art. 30 Records of processing</h1>{_BODY}<h1>Art. 5 Principles</h1><div class='entry-content'>Personal data shall be processed lawfully, fairly and in a transparent manner.</div><h1>Recital 1</h1>{_BODY}"
