"""Notices and texts of public licenses, by SPDX identifier.

Words in braces tell a license from others that are worded alike (its name, its
version, its number of clauses, a condition of its own).  A text has the license
only if all of them are there, each run of them without a word between.
"""

# Names by which a notice calls a license.
NAMES = (
    ("MIT", "MIT License"),
    ("MIT-0", "MIT No Attribution License"),
    ("ISC", "ISC License"),
    ("Zlib", "zlib License"),
    ("Unlicense", "Unlicense"),
    ("Apache-1.0", "Apache License, Version 1.0"),
    ("Apache-1.1", "Apache License, Version 1.1"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License 2.0"),
    ("Apache-2.0", "Apache 2.0 License"),
    ("BSL-1.0", "Boost Software License, Version 1.0"),
    ("BSL-1.0", "Boost Software License 1.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-4-Clause", "BSD 4-Clause License"),
    ("MPL-1.1", "Mozilla Public License, Version 1.1"),
    ("MPL-2.0", "Mozilla Public License, Version 2.0"),
    ("MPL-2.0", "Mozilla Public License 2.0"),
    ("EPL-1.0", "Eclipse Public License, Version 1.0"),
    ("EPL-2.0", "Eclipse Public License, Version 2.0"),
    ("EPL-2.0", "Eclipse Public License 2.0"),
    ("GPL-1.0", "GNU General Public License, version 1"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("LGPL-2.0", "GNU Library General Public License, version 2"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
)
OPENINGS = ("Released under the", "Licensed under the", "This work is licensed under the")
CC_ELEMENTS = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

# Texts and file headers.
TEXTS = (
    (
        "MIT",
        """{Permission is hereby granted, free of charge, to any person obtaining a copy of this software} and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, {subject to the following conditions}: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
        OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "MIT",
        """{Permission is hereby granted, free of charge, to any person obtaining a copy of this software} and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, {subject to the following conditions}: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, {provided that the above copyright notice and this permission notice appear in all copies}. THE
        SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
        USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, {provided that the above copyright notice and this permission notice appear in all copies}.""",
    ),
    (
        "0BSD",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is {hereby
        granted. THE SOFTWARE IS PROVIDED "AS IS"} AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
        to the following restrictions: 1. {The origin of this software must not be misrepresented}; you must not claim
        that you wrote the original software. If you use this software in a product, an acknowledgment in the product
        documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as
        such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered
        from any source distribution.""",
    ),
    (
        "Unlicense",
        """This is free and unencumbered software {released into the public domain}. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for
        any purpose, commercial or non-commercial, and by any means.""",
    ),
    (
        "BSL-1.0",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation {covered by this license (the "Software")} to use, reproduce, display, distribute,
        execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties
        to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software
        and this entire statement, including the above license grant, this restriction and the following disclaimer, must
        be included in all copies of the Software.""",
    ),
    (
        "Apache-2.0",
        """Licensed under the {Apache License, Version 2.0} (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    ),
    (
        "GPL-2.0",
        """This program is free software; you can redistribute it and/or modify it under the terms of the {GNU General
        Public License as published by} the Free Software Foundation; either {version 2 of the License}, or (at your
        option) any later version.""",
    ),
    (
        "GPL-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the {GNU General
        Public License as published by} the Free Software Foundation, either {version 3 of the License}, or (at your
        option) any later version.""",
    ),
    (
        "LGPL-2.1",
        """This library is free software; you can redistribute it and/or modify it under the terms of the {GNU Lesser
        General Public License as published by} the Free Software Foundation; either {version 2.1 of the License}, or (at
        your option) any later version.""",
    ),
    (
        "LGPL-3.0",
        """This library is free software: you can redistribute it and/or modify it under the terms of the {GNU Lesser
        General Public License as published by} the Free Software Foundation, either {version 3 of the License}, or (at
        your option) any later version.""",
    ),
    (
        "AGPL-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the {GNU Affero
        General Public License as published by} the Free Software Foundation, either {version 3 of the License}, or (at
        your option) any later version.""",
    ),
    ("MPL-1.1", "The contents of this file are subject to the {Mozilla Public License Version 1.1} (the \"License\")."),
    (
        "MPL-2.0",
        """This Source Code Form is subject to the terms of the {Mozilla Public License, v. 2.0}. If a copy of the MPL was
        not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the {Mozilla Public License, v. 2.0}."),
    (
        "BSD-2-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. {THIS SOFTWARE IS PROVIDED BY}""",
    ),
    (
        "BSD-3-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. 3. {Neither the name of} the copyright holder nor the names of its
        contributors may be used to {endorse or promote products} derived from this software without specific prior
        written permission.""",
    ),
    (
        "BSD-4-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. 3. All {advertising materials mentioning features} or use of this
        software must display the following acknowledgement: This product includes software developed by the
        organization. 4. {Neither the name of} the copyright holder nor the names of its contributors may be used to
        {endorse or promote products} derived from this software without specific prior written permission.""",
    ),
    ("CC0-1.0", "To the extent possible under law, the author {has waived all copyright} and related rights to this work."),
)

TEMPLATES = (
    *((spdx, f"{opening} {{{name}}}.") for spdx, name in NAMES for opening in OPENINGS),
    *((f"CC-{e}-{v}", f"Licensed under {{CC {e} {v}}}.") for e in CC_ELEMENTS for v in CC_VERSIONS),
    *TEXTS,
)
