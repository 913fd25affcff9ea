"""Sources: table reads, fixture adapters, file/workbook readers, CRM and event parsing."""
