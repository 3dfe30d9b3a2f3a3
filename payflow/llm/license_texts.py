"""Public licence texts, names, notices and equivalent spellings.

The long texts lie in ``license_bodies``, one file per SPDX name, and are read by the driver only.
"""

import re
from pathlib import Path

MIT = """MIT License

Copyright (c) <year> <holder>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""

ISC = """ISC License

Copyright (c) <year> <holder>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""

ZERO_BSD = """BSD Zero Clause License

Copyright (c) <year> <holder>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""

BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""

BSD_START = """{title}

Copyright (c) <year>, <holder>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""

BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""

ZLIB = """zlib License

Copyright (c) <year> <holder>

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.
"""

UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>
"""

#: Entire licence texts by SPDX name.
BODIES = {
    "MIT": MIT,
    "ISC": ISC,
    "0BSD": ZERO_BSD,
    "BSD-2-Clause": BSD_START.format(title="BSD 2-Clause License") + BSD_END,
    "BSD-3-Clause": BSD_START.format(title="BSD 3-Clause License") + BSD_NAMES + BSD_END,
    "Zlib": ZLIB,
    "Unlicense": UNLICENSE,
} | {p.stem: p.read_text(encoding="utf-8") for p in sorted(Path(__file__).with_name("license_bodies").glob("*.txt"))}

#: Long licences are also given without the advice on their use that follows this line.
END_OF_TERMS = "END OF TERMS AND CONDITIONS"
BODY_VARIANTS = [(name, text[:text.index(END_OF_TERMS) + len(END_OF_TERMS)])
                 for name, text in BODIES.items() if END_OF_TERMS in text]

#: What follows "copyright" or "(c)" in the prose of licences: a line that begins so is no copyright notice.
PROSE_WORDS = {"holder", "holders", "notice", "notices", "owner", "owners", "law", "laws", "license", "licence"} | {
    word for text in BODIES.values() for found in re.findall(r"(?:copyright|\(c\))[^a-z0-9]+([a-z]+)", text.lower())
    for word in (found, found.replace("licens", "licenc"))} - {"c", "year", "yyyy"}

#: How notices call a licence.
NAMES = {
    "MIT": ["MIT License"],
    "ISC": ["ISC License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"],
    "GPL-2.0-only": ["GNU General Public License, version 2", "GPL v2"],
    "GPL-3.0-only": ["GNU General Public License, version 3", "GPL v3"],
    "LGPL-3.0-only": ["GNU Lesser General Public License, version 3", "LGPL v3"],
    "AGPL-3.0-only": ["GNU Affero General Public License, version 3", "AGPL v3"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero 1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "Unlicense": ["Unlicense"],
    "Zlib": ["zlib License"],
}

#: Notices around such a name; the article is dropped by the spellings.
NOTICES = ["Released under {}.", "Licensed under {}.", "Distributed under {}.", "This work is licensed under {}.",
           "This software is licensed under {}.", "This project is licensed under {}.",
           "This program is licensed under {}.", "This work is released under {}."]

#: What is dropped after "under", longest first.
UNDER = ["under the terms of the", "under terms of the", "under the terms of", "under terms of", "under the", "under an", "under a"]


def _over_line_end(phrases: list[str]) -> str:
    """Pattern for the phrases with one of their blanks at a line's end."""
    return "|".join(" ".join(words[:i]) + r" *\n *" + " ".join(words[i:])
                    for words in map(str.split, phrases) for i in range(1, len(words)))


#: Canonical spelling: what else is written for it (after lower case, marks as blanks). Over a line's end the break stays.
SPELLINGS = {
    "sublicense\n": _over_line_end(["sub license", "sub licence"]),
    "noncommercial\n": _over_line_end(["non commercial"]),
    "noninfringement\n": _over_line_end(["non infringement"]),
    "sharealike\n": _over_line_end(["share alike"]),
    "under\n": _over_line_end(UNDER),
    "license": "licence",
    "licensed": "licenced",
    "sublicense": "sub license|sublicence|sub licence",
    "noncommercial": "non commercial",
    "noninfringement": "non infringement",
    "sharealike": "share alike",
    "acknowledgment": "acknowledgement",
    "recognize": "recognise",
    "version": "v|ver",
    "under": "under (?:the )?terms of the|under (?:the )?terms of|under the|under an|under a",
    "http": "https",
}
