"""Wording of licences as template markup.

``<<beginOptional>>`` ... ``<<endOptional>>`` encloses words that a text may leave out, ``<<var;most=N>>`` stands for up to N
words of any kind (a holder, a year), ``<<oneof=a|b>>`` for one of the given wordings. All else must be there, word for word.
"""

# Phrases that name a licence, and its label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Published wording of licence notices and texts, label first.
_WARRANTY = """
<<beginOptional>>THIS SOFTWARE IS PROVIDED BY <<var;most=12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;most=12>>
BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES<<endOptional>>"""
_BSD_2 = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: <<var;most=1>> Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. <<var;most=1>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution."""
_LATER = "<<beginOptional>>, or (at your option) any later version<<endOptional>>"
TEMPLATES = [
    ("mit-notice", """
<<oneof=released|licensed|distributed|available>> under the <<beginOptional>>terms of the<<endOptional>> MIT License"""),
    ("mit-text", """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
<<beginOptional>>(the "Software")<<endOptional>>, to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
<<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
<<beginOptional>>THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;most=12>> BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY<<endOptional>>"""),
    ("apache-2.0", """
Licensed under the Apache License <<beginOptional>>, Version<<endOptional>> <<oneof=2.0|2>>"""),
    ("apache-2.0-header", """
Licensed under the Apache License, Version 2.0 <<beginOptional>>(the "License")<<endOptional>>; you may not use <<var;most=6>> except in
compliance with the License. You may obtain a copy of the License at <<var;most=12>> Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl-3.0", "under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License, <<oneof=version 3|version 3.0|v3>>" + _LATER),
    ("gpl-2.0", "under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License, <<oneof=version 2|version 2.0|v2>>" + _LATER),
    ("gpl-header", """
This program is free software <<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU
<<oneof=General|Lesser General|Affero General>> Public License as published by the Free Software Foundation, either version
<<oneof=1|2|2.1|3>> of the License, or (at your option) any later version."""),
    ("lgpl", "GNU <<oneof=Lesser|Library>> General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("mpl-2.0", """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. <<beginOptional>>If a copy of the MPL was not distributed
with this file, You can obtain one at <<var;most=8>><<endOptional>>"""),
    ("bsd-2-clause", _BSD_2 + _WARRANTY),
    ("bsd-3-clause", _BSD_2 + """
<<var;most=1>> Neither the name of <<var;most=12>> nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission.""" + _WARRANTY),
    ("isc", """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies."""),
    ("unlicense", """
This is free and unencumbered software released into the public domain. <<beginOptional>>Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means.<<endOptional>>"""),
    ("cc0", "<<oneof=CC0 1.0|Creative Commons Zero|Creative Commons CC0>>"),
    ("cc-by-nc", "<<oneof=CC BY-NC|Creative Commons Attribution-NonCommercial>> <<beginOptional>><<oneof=4.0|3.0|2.5|2.0>><<endOptional>>"),
    ("cc-by-sa", "<<oneof=CC BY-SA|Creative Commons Attribution-ShareAlike>> <<beginOptional>><<oneof=4.0|3.0|2.5|2.0>><<endOptional>>"),
    ("cc-by-nd", "<<oneof=CC BY-ND|Creative Commons Attribution-NoDerivatives>> <<beginOptional>><<oneof=4.0|3.0|2.5|2.0>><<endOptional>>"),
]
