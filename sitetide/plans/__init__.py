"""sitetide.plans"""
