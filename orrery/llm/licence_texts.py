"""Openings, notices and key paragraphs of well-known public licences, by family."""

TEMPLATES: list[tuple[str, str]] = [
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mit", "Dual licensed under the MIT and GPL licenses."),
    ("mit", "Licensed under the MIT license."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("apache", "Released under the Apache 2.0 license."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", "This software is released under the 3-clause BSD License."),
    ("bsd", "Released under the BSD License."),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "This is licensed under GPLv2."),
    ("gpl", "Licensed under the GPL version 2 or later."),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("agpl", "You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("agpl", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("epl", "Eclipse Public License 2.0"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("epl", "SPDX-License-Identifier: EPL-2.0"),
    ("mpl", "SPDX-License-Identifier: MPL-2.0"),
    ("mpl", "Licensed under the Mozilla Public License, version 2.0."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("isc", "Released under the ISC License."),
    ("isc", "SPDX-License-Identifier: ISC"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("public-domain", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal."),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
    ("public-domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher."),
    ("proprietary", "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited."),
]

#: Lines that speak of the same things without granting anything.
OTHERS: list[str] = [
    "He lost his license after driving without insurance in the city.",
    "The restaurant was granted a licence to sell alcohol until midnight.",
    "The library is open to the general public on every work day.",
    "You can buy a driving license at the public office for a small fee.",
    "The software version of the game was released in March.",
    "Permission from the parents is needed for the trip to the museum.",
    "The author of this work studied at MIT before he joined the foundation.",
    "Under the terms of the agreement both sides will reduce their forces.",
    "The warranty covers all parts of the car for two years.",
    "The Apache helicopter was used in the mission.",
    "A copy of the letter was found in the documentation of the case.",
    "Free copies of the book were distributed to all persons at the door.",
    "The rights of workers are limited by the law in this state.",
    "Mozilla released a new version of its browser for general use.",
    "The following conditions must be met before the project can start.",
]
