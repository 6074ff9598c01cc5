"""Phrases and notices that the license scan looks for."""

#: Phrases of the base contract, with the label each one gives.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

#: Opening passages of well-known license notices, with the label each one gives.
NOTICES = {
    "mit": """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute,
        sublicense, and/or sell copies of the Software
    """,
    "apache": """
        you may not use this file except in compliance with the License. You may obtain a copy of the
        License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed
        to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
    """,
    "gpl": """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation
    """,
    "bsd": """
        Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met
    """,
    "mpl": """
        This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of
        the MPL was not distributed with this file, You can obtain one at
    """,
    "isc": """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without
        fee is hereby granted
    """,
}
