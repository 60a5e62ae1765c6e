"""Licence texts as they are published, wrapped, unwrapped and as comments."""

import textwrap

from mirrorlake.llm import license_scan

HOLDER = "Copyright (c) 2020 Some Holder"
MIT = [
    "MIT License",
    HOLDER,
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
]
BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
BSD2 = [
    HOLDER + "\nAll rights reserved.",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    BSD_END,
]
BSD3 = [*BSD2[:4], "3. Neither the name of Some Holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", BSD_END]
APACHE = [
    HOLDER,
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
]


def gnu(title, version, end="If not, see <https://www.gnu.org/licenses/>."):
    return [
        f"Frobnicate is free software: you can redistribute it and/or modify it under the terms of the GNU {title} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
        f"Frobnicate is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {title} for more details.",
        f"You should have received a copy of the GNU {title} along with Frobnicate. {end}",
    ]


MPL = ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."]
ISC = [
    HOLDER,
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
]
TEXTS = {
    "MIT": MIT,
    "BSD-2-Clause": BSD2,
    "BSD-3-Clause": BSD3,
    "Apache-2.0": APACHE,
    "GPL-2.0-or-later": gnu("General Public License", "2", "if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."),
    "GPL-3.0-or-later": gnu("General Public License", "3"),
    "LGPL-2.1-or-later": gnu("Lesser General Public License", "2.1"),
    "LGPL-3.0-or-later": gnu("Lesser General Public License", "3"),
    "AGPL-3.0-or-later": gnu("Affero General Public License", "3"),
    "MPL-2.0": MPL,
    "ISC": ISC,
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
}


def comment(text):
    return "/*\n" + "".join(f" * {x}".rstrip() + "\n" for x in text.split("\n")) + " */\nint main() { return 0; }\n"


def test_published_texts(spark):
    rows, want = [], {}
    for licence, parts in TEXTS.items():
        flat = "\n\n".join(parts)
        wrapped = "\n\n".join(textwrap.fill(p, 72) if "\n" not in p else p for p in parts)
        for text in (flat, wrapped, comment(wrapped), "Some words before.\n\n" + wrapped.replace("\n", "\r\n") + "\r\n\r\nAnd after", textwrap.indent(wrapped, "# ")):
            want[len(rows)] = licence
            rows.append((len(rows), text))
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wrong = {i: (want[i], got[i].licences, got[i].sequence) for i in want if got[i].licences != want[i]}
    assert not wrong
    assert all(got[i].n_left_over == 0 for i in want)


def test_declarations_gaps_and_what_isnt_a_licence(spark):
    unknown = "Some sentence in between. "
    grant, notice = MIT[2][:-1] + ".", MIT[3]
    texts = {
        1: ("Hello there. Licensed under the Apache License, Version 2.0.\nThe end", "Apache-2.0"),
        2: ("no stop here\nReleased under the MIT License.\nThis work is licensed under the GNU General Public License, version 3.\nmore", "MIT,GPL-3.0"),
        3: ("Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        4: ("// SPDX-License-Identifier: BSD-3-Clause\nint x;", "BSD-3-Clause"),
        5: (HOLDER + "\nAll rights reserved.", ""),
        6: (grant + " " + unknown * 3 + notice, "MIT"),
        7: (grant + " " + unknown * 4 + notice, ""),
        8: (notice + " " + grant, ""),
        9: ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright", "GPL-3.0"),
        10: ("    Apache License\n    Version 2.0, January 2004\n    http://www.apache.org/licenses/\n", "Apache-2.0"),
        11: ("", ""),
        12: (None, ""),
        13: ("nothing " * 50_000 + "\n\nReleased under the MIT License.\n" + "and more\n" * 50_000, "MIT"),
    }
    docs = spark.createDataFrame([(i, t, "a", 1) for i, (t, _) in texts.items()], "doc_id long, text string, sequence string, licences int")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert {i: r.licences for i, r in got.items()} == {i: w for i, (_, w) in texts.items()} | {2: got[2].licences}
    assert sorted(got[2].licences.split(",")) == ["GPL-3.0", "MIT"]
    assert got[7].n_left_over == 2 and got[6].sequence == "<MitGrant>~<MitNotice>" and got[7].sequence == "<MitGrant>=<MitNotice>"
