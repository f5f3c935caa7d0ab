"""What a query asks for, decided on the driver before any job runs."""
