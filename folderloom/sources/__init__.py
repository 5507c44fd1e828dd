"""File listings, content hashes and the CSV, JSON, workbook and archive scans."""
