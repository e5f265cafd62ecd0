"""Texts that licence scans compare with: whole licence files and the statements that name a licence."""

from __future__ import annotations

# Public licence texts as their authors publish them.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THREE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_ISC_HEAD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_0BSD_HEAD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_UNLICENSE_HEAD = "This is free and unencumbered software released into the public domain."
_UNLICENSE = _UNLICENSE_HEAD + """

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ZLIB_HEAD = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."
_ZLIB = _ZLIB_HEAD + """

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def _gnu(what: str, name: str, version: str) -> str:
    """The notice that the GNU licences ask to put into source files."""
    return f"{what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."


#: Whole texts, which only files with a licence's usual name are compared with.
WHOLE: dict[str, list[str]] = {
    "0BSD": [f"{_0BSD_HEAD}\n\n{_ISC_TAIL}"],
    "BSD-2-Clause": [f"{_BSD_HEAD}:\n\n{_BSD_TWO}\n\n{_BSD_TAIL}"],
    "BSD-3-Clause": [f"{_BSD_HEAD}:\n\n{_BSD_TWO}\n\n3. {_BSD_THREE}\n\n{_BSD_TAIL}"],
    "ISC": [f"{_ISC_HEAD}\n\n{_ISC_TAIL}"],
    "MIT": [_MIT],
    "Unlicense": [_UNLICENSE],
    "Zlib": [_ZLIB],
}

#: Statements: titles, notices for source files, paragraphs that only one licence has, and how texts refer to a licence.
STATEMENTS: dict[str, list[str]] = {
    "0BSD": ["BSD Zero Clause License", _0BSD_HEAD],
    "AGPL-3.0": ["GNU Affero General Public License Version 3, 19 November 2007", _gnu("This program", "Affero General Public License", "3"), "Licensed under the GNU Affero General Public License, version 3"],
    "Apache-2.0": ["Apache License Version 2.0, January 2004", _APACHE, _APACHE.split("\n")[0], "Licensed under the Apache License, Version 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", _BSD_HEAD, _BSD_THREE],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 International", "Licensed under CC BY 4.0"],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0"],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0"],
    "CC0-1.0": ["CC0 1.0 Universal", "Creative Commons Legal Code CC0 1.0 Universal"],
    "GPL-2.0": ["GNU General Public License Version 2, June 1991", _gnu("This program", "General Public License", "2"), "This program is free software under the GNU General Public License, version 2"],
    "GPL-3.0": ["GNU General Public License Version 3, 29 June 2007", _gnu("This program", "General Public License", "3"), "This work is licensed under the GNU General Public License, version 3"],
    "ISC": ["ISC License", _ISC_HEAD],
    "LGPL-2.1": ["GNU Lesser General Public License Version 2.1, February 1999", _gnu("This library", "Lesser General Public License", "2.1"), "Licensed under the GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License Version 3, 29 June 2007", _gnu("This library", "Lesser General Public License", "3"), "This library is licensed under the GNU Lesser General Public License, version 3"],
    "MIT": ["MIT License", "The MIT License (MIT)", "Released under the MIT License", "Licensed under the MIT License", _MIT.split("\n")[0]],
    "MPL-2.0": ["Mozilla Public License Version 2.0", _MPL, _MPL.split(" If a ")[0]],
    "Unlicense": [_UNLICENSE_HEAD],
    "Zlib": ["zlib License", _ZLIB_HEAD],
}
for _name, _texts in STATEMENTS.items():
    _texts.append(f"SPDX-License-Identifier: {_name}")
    if "GPL" in _name:
        _texts += [f"SPDX-License-Identifier: {_name}-only", f"SPDX-License-Identifier: {_name}-or-later"]

#: Statements that count only where no licence is named.
RESERVED: dict[str, list[str]] = {"Proprietary": ["Copyright, all rights reserved", "All rights reserved"]}
