"""The notices that licenses.py looks for: of each license the standard text or header, and the usual short forms.

The wording is the licenses' own, as they ask to be quoted.
"""

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
    "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy "
    'of this software and associated documentation files (the "Software"), to deal '
    "in the Software without restriction, including without limitation the rights "
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is "
    "furnished to do so"
)
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without "
    "modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, "
    "this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors "
    "may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_BSD_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
    '"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED "
    "TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(what: str, name: str, version: str) -> str:
    """The notice that the GNU licenses ask to be put at the head of a file."""
    head = f"{what} is free software; you can redistribute it and/or modify"
    terms = f"it under the terms of the {name} as published by the Free Software Foundation"
    return f"{head} {terms}; either version {version} of the License, or (at your option) any later version."


def _gnu_only(what: str, name: str) -> str:
    hope = f"{what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"
    purpose = "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"
    return f"{hope}; {purpose}. See the {name} for more details."


def _creative(kind: str, version: str) -> tuple[str, ...]:
    return (f"This work is licensed under a Creative Commons {kind} {version} International License.", f"licensed under the Creative Commons {kind} {version} International License")


_GPL, _LGPL, _AGPL = "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License"

#: License -> its notices; any of them is a hit.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "all-rights-reserved": ("All rights reserved.",),
    "agpl-3.0": (_gnu("This program", _AGPL, "3"), f"licensed under the {_AGPL} version 3", f"licensed under the {_AGPL} v3.0"),
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except '
        "in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS '
        "OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.",
        "under the terms of the Apache License 2.0",
        "released under the Apache 2.0 license",
    ),
    "bsd-2-clause": (_BSD_TERMS + _BSD_AS_IS, "released under the BSD 2-Clause License", "licensed under the simplified BSD license"),
    "bsd-3-clause": (
        _BSD_TERMS + _BSD_NAMES + _BSD_AS_IS,
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "released under the BSD 3-Clause License",
        "licensed under the new BSD license",
    ),
    "bsl-1.0": (
        "Boost Software License - Version 1.0 - August 17th, 2003",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    ),
    "cc-by-4.0": (*_creative("Attribution", "4.0"), "Licensed under CC BY 4.0."),
    "cc-by-nc-4.0": (*_creative("Attribution-NonCommercial", "4.0"), "Licensed under CC BY-NC 4.0."),
    "cc-by-nc-sa-4.0": (*_creative("Attribution-NonCommercial-ShareAlike", "4.0"), "Licensed under CC BY-NC-SA 4.0."),
    "cc-by-nd-4.0": (*_creative("Attribution-NoDerivatives", "4.0"), "Licensed under CC BY-ND 4.0."),
    "cc-by-sa-4.0": (*_creative("Attribution-ShareAlike", "4.0"), "Licensed under CC BY-SA 4.0."),
    "cc0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights "
        "to this software to the public domain worldwide. This software is distributed without any warranty.",
        "CC0 1.0 Universal Public Domain Dedication",
    ),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/",
        "licensed under the Eclipse Public License version 2.0",
    ),
    "gpl-2.0": (_gnu("This program", _GPL, "2"), f"licensed under the {_GPL} version 2", f"licensed under the {_GPL} v2.0"),
    "gpl-3.0": (_gnu("This program", _GPL, "3"), f"This work is licensed under the {_GPL}, version 3.", f"licensed under the {_GPL} v3.0"),
    "gpl-warranty": (_gnu_only("This program", _GPL),),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose "
        "with or without fee is hereby granted, provided that the above copyright notice "
        'and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" '
        "AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "released under the ISC License",
    ),
    "lgpl-2.1": (_gnu("This library", _LGPL, "2.1"), f"licensed under the {_LGPL} version 2.1", f"licensed under the {_LGPL} v2.1"),
    "lgpl-3.0": (_gnu("This library", _LGPL, "3"), f"licensed under the {_LGPL} version 3", f"licensed under the {_LGPL} v3.0"),
    "mit": (
        _MIT_GRANT + ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software. " + _AS_IS + "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Released under the MIT License.",
        "licensed under the MIT License",
        "distributed under the MIT License",
        "available under the MIT License",
        "under the terms of the MIT License",
    ),
    "mit-grant": (_MIT_GRANT, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "licensed under the Mozilla Public License 2.0",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.",
        "This is free and unencumbered software released into the public domain.",
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely",
    ),
}
