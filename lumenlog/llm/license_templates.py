"""Wording of well-known public licenses and notices, in template markup (see ``licenses.compile_templates``).

Fixed values: the mandatory wording is that of the published texts, in their order. Optional parts stand between beginOptional and
endOptional; replaceable parts (holders, years, numbering) are var regions with the number of words they may take.
"""

_NUMBER = '<<var;name="bullet";words="0-1">>'
_HOLDER = '<<var;name="holder";words="1-8">>'
_COPYRIGHT = '<<beginOptional>>Copyright (c) <<beginOptional>>(c)<<endOptional>> <<var;name="copyright";words="0-16">>' \
             ' <<beginOptional>>All rights reserved.<<endOptional>><<endOptional>>'

_BSD_DISCLAIMER = f"""
THIS SOFTWARE IS PROVIDED BY {_HOLDER} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {_HOLDER} BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_BSD_TWO = f"""{_COPYRIGHT}
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
{_NUMBER} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
{_NUMBER} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""

_GPL_NOTICE = """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version {v} of the
License<<beginOptional>>, or (at your option) any later version<<endOptional>>.
<<beginOptional>>This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details.<<endOptional>>"""

#: (label, template)
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", f"""<<beginOptional>>The MIT License <<beginOptional>>(MIT)<<endOptional>><<endOptional>> {_COPYRIGHT}
Permission is hereby granted, free of charge, to any person obtaining a copy of {_HOLDER} <<beginOptional>>(the
"Software")<<endOptional>>, to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included
in all copies or substantial portions of the Software.
<<beginOptional>>THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {_HOLDER} BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.<<endOptional>>"""),
    ("MIT", "released under the <<beginOptional>>terms of the<<endOptional>> MIT License"),
    ("MIT", "licensed under the <<beginOptional>>terms of the<<endOptional>> MIT License"),
    ("ISC", f"""<<beginOptional>>ISC License<<endOptional>> {_COPYRIGHT}
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND {_HOLDER} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {_HOLDER} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", _BSD_TWO + _BSD_DISCLAIMER),
    ("BSD-3-Clause", f"""{_BSD_TWO}
{_NUMBER} Neither the name of {_HOLDER} nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission.{_BSD_DISCLAIMER}"""),
    ("Apache-2.0", """<<beginOptional>>Copyright <<var;name="copyright";words="0-16">><<endOptional>>
Licensed under the Apache License, Version 2.0
<<beginOptional>>(the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License
at <<beginOptional>>http://www.apache.org/licenses/LICENSE-2.0<<endOptional>>
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License.<<endOptional>>"""),
    ("GPL-2.0", _GPL_NOTICE.format(v="2")),
    ("GPL-3.0", _GPL_NOTICE.format(v="3")),
    ("GPL-2.0", "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License, version 2"),
    ("GPL-3.0", "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License, version 3"),
    ("CC-BY-4.0", """licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>>
<<beginOptional>>Attribution<<endOptional>> CC BY 4.0"""),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "licensed under <<beginOptional>>a Creative Commons<<endOptional>> CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", """licensed under a Creative Commons <<beginOptional>>Attribution<<endOptional>> NonCommercial 4.0
International License"""),
    ("CC-BY-SA-4.0", "licensed under <<beginOptional>>a Creative Commons<<endOptional>> CC BY-SA 4.0"),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
<<beginOptional>>Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means.<<endOptional>>"""),
    ("Zlib", f"""{_COPYRIGHT}
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute
it freely, subject to the following restrictions:
{_NUMBER} The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
{_NUMBER} Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
{_NUMBER} This notice may not be removed or altered from any source distribution."""),
]
